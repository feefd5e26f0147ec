"""Source files, diffs, requests and policies derived from the given tables.

Every derivation is a narrow per-row projection: no shuffle, no explode, and
the size of what it yields grows with the text it reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.functions.frames import settled
from codesieve.functions.text import text_array
from codesieve.sources import templates as T
from codesieve.sources.tables import spread, table


def _slot(doc_id: Column) -> Column:
    return (doc_id % 10).cast("int")


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(text_array(values), (index + 1).cast("int"))


def language_of(doc_id: Column) -> Column:
    return _pick([slot[0] for slot in T.SLOTS], _slot(doc_id))


def path_of(doc_id: Column) -> Column:
    group = F.floor(doc_id / 10)
    layer = _pick(T.LAYERS, group % len(T.LAYERS))
    extension = _pick([T.EXTENSIONS.get(slot[0], "") for slot in T.SLOTS], _slot(doc_id))
    code = F.concat(
        F.when(layer == "tests", F.lit("tests/unit/test_f")).otherwise(
            F.concat(F.lit("src/"), layer, F.lit("/pkg"), (doc_id % 7).cast("string"), F.lit("/f"))),
        doc_id.cast("string"), extension)
    doc = F.concat(F.lit("docs/d"), doc_id.cast("string"), F.lit("/"), _pick(T.DOC_NAMES, group % len(T.DOC_NAMES)))
    manifest = F.concat(F.lit("deploy/m"), doc_id.cast("string"), F.lit("/"),
                        _pick(T.MANIFEST_NAMES, group % len(T.MANIFEST_NAMES)))
    return F.when(_slot(doc_id) == 8, doc).when(_slot(doc_id) == 9, manifest).otherwise(code)


def _woven(doc_id: Column, text: Column) -> Column:
    """Each text line (whole) followed by one snippet, joined by newlines."""
    pool, start, sizes, prefixes = [], [], [], []
    offsets: dict[tuple, int] = {}
    for _, snippets, prefix in T.SLOTS:
        key = tuple(snippets)
        if key not in offsets:
            offsets[key] = len(pool)
            pool += snippets
        start.append(offsets[key])
        sizes.append(len(snippets))
        prefixes.append(prefix)
    by_slot = lambda values: F.split(F.lit(",".join(map(str, values))), ",")
    at_slot = lambda values: F.element_at(by_slot(values), _slot(doc_id) + 1).cast("int")
    n = (doc_id % 97).cast("string")

    def piece(line: Column, pos: Column) -> Column:
        pick = (doc_id * 7 + pos * 13 + F.floor(doc_id / 10)) % at_slot(sizes) + at_slot(start) + 1
        snippet = F.element_at(text_array(pool), pick.cast("int"))
        two = F.lpad(((doc_id + pos) % 18 + 1).cast("string"), 2, "0")
        for mark, value in (("{n}", n), ("{j}", pos.cast("string")), ("{k}", two)):
            snippet = F.replace(snippet, F.lit(mark), value)
        return F.concat(_pick(prefixes, _slot(doc_id)), line, F.lit("\n"), snippet)

    extra = F.array_repeat(F.lit("end"), (doc_id % 6 + 3).cast("int"))
    return F.array_join(F.transform(F.concat(F.split(text, "\n"), extra), piece), "\n")


def code_files(spark: SparkSession, sf_dir: str, always: bool = False) -> DataFrame:
    """``(doc_id, path, language, content)``, one file per document; ``always`` deals the documents out (``spread``)."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", always)
    doc_id = F.col("doc_id")
    rows = docs.select("doc_id", path_of(doc_id).alias("path"), language_of(doc_id).alias("language"), _woven(doc_id, F.col("text")).alias("content"))
    # Only the content is settled, so a filter on the language comes before the rendering.
    return rows.select("doc_id", "path", "language", F.inline(F.array(F.struct("content"))))


def diff_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(diff_id, diff)``: one unified diff per document, three sections each.

    Section one changes (or adds) the document's file, section two is a test
    file for every fourth document, section three is a binary, deleted or
    renamed file.
    """
    files = code_files(spark, sf_dir)
    doc_id = F.col("doc_id")
    lines = F.split(F.col("content"), "\n")
    marks = lambda line, i: F.element_at(text_array([" ", "+", "-"]), ((doc_id + i) % 3 + 1).cast("int"))
    # Every fifth diff adds a new file, so all its lines are additions.
    is_new = doc_id % 5 == 1
    body = F.when(is_new, F.transform(lines, lambda line: F.concat(F.lit("+"), line))).otherwise(
        F.transform(lines, lambda line, i: F.concat(marks(line, i), line)))
    count = lambda sign: F.size(F.filter(F.col("body"), lambda line: ~F.startswith(line, F.lit(sign)))).cast("string")
    header = F.when(is_new, F.concat(
        F.lit("diff --git a/"), F.col("path"), F.lit(" b/"), F.col("path"),
        F.lit("\nnew file mode 100644\n--- /dev/null\n+++ b/"), F.col("path"))).otherwise(F.concat(
            F.lit("diff --git a/"), F.col("path"), F.lit(" b/"), F.col("path"),
            F.lit("\nindex 1111111..2222222 100644\n--- a/"), F.col("path"), F.lit("\n+++ b/"), F.col("path")))
    start = F.when(is_new, F.lit(1)).otherwise(doc_id % 9 + 1).cast("string")
    main = F.concat(header, F.lit("\n@@ -"), start, F.lit(","), count("+"), F.lit(" +"), start, F.lit(","),
                    count("-"), F.lit(" @@\n"), F.array_join("body", "\n"))
    ident = doc_id.cast("string")
    test_file = F.concat(
        F.lit("\ndiff --git a/tests/test_c"), ident, F.lit(".py b/tests/test_c"), ident,
        F.lit(".py\n--- a/tests/test_c"), ident, F.lit(".py\n+++ b/tests/test_c"), ident,
        F.lit(".py\n@@ -4 +4,2 @@\n     assert run()\n+    assert done("), ident, F.lit(")"))
    binary = F.concat(F.lit("\ndiff --git a/img/p"), ident, F.lit(".png b/img/p"), ident,
                      F.lit(".png\nnew file mode 100644\nBinary files /dev/null and b/img/p"), ident, F.lit(".png differ"))
    deleted = F.concat(F.lit("\ndiff --git a/old/g"), ident, F.lit(".py b/old/g"), ident,
                       F.lit(".py\ndeleted file mode 100644\n--- a/old/g"), ident,
                       F.lit(".py\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-import os\n--- not a header"))
    renamed = F.concat(F.lit("\ndiff --git a/lib/from"), ident, F.lit(".js b/lib/to"), ident,
                       F.lit(".js\nsimilarity index 90%\nrename from lib/from"), ident, F.lit(".js\nrename to lib/to"),
                       ident, F.lit(".js\n--- a/lib/from"), ident, F.lit(".js\n+++ b/lib/to"), ident,
                       F.lit(".js\n@@ -7,2 +7,3 @@\n ctx();\n+// add code here later\n tail();\n\\ No newline at end of file"))
    third = F.when(doc_id % 3 == 0, binary).when(doc_id % 3 == 1, deleted).otherwise(renamed)
    return settled(settled(files.withColumn("body", body)).select(
        doc_id.alias("diff_id"),
        F.concat(main, F.when(doc_id % 4 == 0, test_file).otherwise(F.lit("")), third).alias("diff")))


def rpc_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(seq, raw)``: one request line per event, some broken on purpose."""
    events = spread(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "props"), "event_id")
    return events.select(F.col("event_id").alias("seq"), frame_of(
        F.col("event_id"), F.col("event_type"), F.col("user_id"), F.col("props")).alias("raw"))


def frame_of(event_id: Column, event_type: Column, user_id: Column, props: Column) -> Column:
    method = (F.when(event_type == "view", F.lit("initialize")).when(event_type == "signup", F.lit("tools/list"))
              .when(event_type == "click", F.lit("tools/call")).when(event_type == "purchase", F.lit("ping"))
              .otherwise(F.lit("no/such")))
    params = (F.when(event_type == "view", F.concat(
        F.lit('{"protocolVersion":"'),
        F.element_at(text_array(["2024-11-05", "2025-03-26", "1999-01-01"]), (event_id % 3 + 1).cast("int")),
        F.lit('"}')))
        .when(event_type == "click", F.concat(
            F.lit('{"name":"'),
            F.element_at(text_array(["scan_code", "get_corpus", "nope", "verify"]), (user_id % 4 + 1).cast("int")),
            F.lit('","arguments":'), F.when(event_id % 13 == 0, F.lit('"x"')).otherwise(props), F.lit("}")))
        .otherwise(F.when(event_id % 17 == 0, F.lit("[1]")).otherwise(F.lit("{}"))))
    ident = F.when(event_id % 7 == 0, F.lit("")).otherwise(
        F.concat(F.lit(',"id":'), event_id.cast("string")))
    version = F.when(event_id % 19 == 0, F.lit("1.0")).otherwise(F.lit("2.0"))
    method_part = (F.when(event_id % 23 == 0, F.lit(""))
                   .when(event_id % 29 == 0, F.lit(',"method":5'))
                   .otherwise(F.concat(F.lit(',"method":"'), method, F.lit('"'))))
    frame = F.concat(F.lit('{"jsonrpc":"'), version, F.lit('"'), ident, method_part, F.lit(',"params":'), params, F.lit("}"))
    return F.when(event_id % 11 == 0, F.concat(F.lit("!"), frame)).when(event_id % 31 == 0, F.lit("  ")).otherwise(frame)


def policy_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(config_id, raw)``: one review policy per event, valid and invalid."""
    events = spread(table(spark, sf_dir, "events").select("event_id", "props"), "event_id")
    e = F.col("event_id")
    raw = (F.when(e % 9 == 0, F.concat(F.lit('{"exclude":["vendor/*"],"business_logic":'), F.col("props"), F.lit("}")))
           .when(e % 9 == 1, F.concat(F.lit('{"min_test_trigger_lines":'), (e % 40).cast("string"), F.lit(',"require_tests":"fail"}')))
           .when(e % 9 == 2, F.lit('{"require_tests":"sometimes"}'))
           .when(e % 9 == 3, F.concat(F.lit('{"fail_on_review":true,"test_globs":["qa/*","k'), e.cast("string"), F.lit('*"]}')))
           .when(e % 9 == 4, F.concat(F.lit('{"min_test_trigger_lines":-'), (e % 40 + 1).cast("string"), F.lit("}")))
           .when(e % 9 == 5, F.col("props"))
           .when(e % 9 == 6, F.concat(F.lit('{"exclude":[1,'), e.cast("string"), F.lit("]}")))
           .when(e % 9 == 7, F.concat(F.lit("[{"), e.cast("string")))
           .otherwise(F.lit('{"fail_on_review":"yes"}')))
    return events.select(e.alias("config_id"), raw.alias("raw"))
