"""Steps that read a text once, make no row per token, and don't copy a file for each of its lines."""

from __future__ import annotations

import math
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codesieve.functions.literals import alternatives, lowered, signs
from codesieve.functions.text import folded, found, hits, held_signs, likely, may_match
from codesieve.operators import metrics, naming, paths, security, stubs, wording
from codesieve.operators.lines import masked_lines
from codesieve.plans.queries import build_registry
from codesieve.rulebook import style as R
from codesieve.sources import diffs

FILES = "path string, language string, content string"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def of(spark, *texts, language="python"):
    return spark.createDataFrame([(f"f{i}.py", language, t) for i, t in enumerate(texts)], FILES)


@pytest.fixture
def small_tables(spark, tmp_path):
    docs = [(i, f"some text {i}\nimport os\n# note that this is {i}\n" * 3, "en", "web") for i in range(20)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_comments_of_many_docstrings_take_linear_time(spark):
    files = of(spark, '"""\nbody text\n"""\nx = 1  # why\n' * 4000)
    began = time.time()
    rows = wording.comments(files).groupBy("text").count().collect()
    assert {r["text"]: r["count"] for r in rows} == {'""" body text """': 4000, "why": 4000}
    assert time.time() - began < 30


def test_redundant_comments_and_snippets_take_no_slice(spark):
    files = of(spark, "# load user name\n\n# other\nload user name\nx = 2\n")
    rows = wording.redundant_comments(files)
    assert [(r["line_no"], r["overlap"]) for r in rows.collect()] == [(1, 1.0)]
    assert "slice(" not in plan(rows.select("path")).split("Join")[0]
    lines = F.split(F.lit("a\nb\nc"), "\n")
    shown = spark.range(1).select(*[paths.snippet(lines, F.lit(k), 1).alias(f"s{k}") for k in (1, 2, 3)])
    assert list(shown.first()) == [">>>    1 | a\n       2 | b", "       1 | a\n>>>    2 | b\n       3 | c", "       2 | b\n>>>    3 | c"]
    assert "slice(" not in plan(files.select(paths.snippet(F.split("content", "\n"), F.length("path"), 1)))


def test_scores_of_sections_are_computed_once(spark):
    files = of(spark, "def a():\n    if x:\n        pass\n")
    assert plan(metrics.cognitive_hotspots(files)).count("aggregate(") == 1
    assert plan(naming.long_functions(files)).count("array_position(") == 1


def test_frequencies_without_a_row_per_token(spark):
    text = "alpha beta gamma delta " * 6 + "one two three four five six seven eight nine ten alpha beta gamma"
    files = of(spark, text, text, "short text").withColumn("path", F.when(F.col("path") == "f1.py", "f0.py").otherwise(F.col("path")))
    top = metrics.repeated_triples(files)
    tokens = re.findall(r"\b\w+\b", text)
    grams = [" ".join(tokens[i:i + 3]) for i in range(len(tokens) - 2)]
    want = sorted(((2 * n, -grams.index(g), g) for g, n in Counter(grams).items() if 2 * n > 2), reverse=True)[:10]
    assert [(r["n"], r["gram"], r["rank"]) for r in top.orderBy("path", "rank").collect()] == [(n, g, k) for k, (n, _, g) in enumerate(want, 1)]
    assert "explode(" not in plan(top) and "explode(" not in plan(metrics.token_entropies(files))
    words = [w for w in text.split() if w not in R.ENTROPY_STOP_TOKENS]
    entropy = -sum(n / len(words) * math.log2(n / len(words)) for n in Counter(words).values())
    assert {r["path"]: round(r["entropy"], 6) for r in metrics.token_entropies(files).collect()} == {"f0.py": round(entropy, 6), "f2.py": 5.0}


def test_guards_of_alternations(spark):
    assert alternatives(r"\b(?:yes|hello)\b", "i") == ("hello", "yes")
    assert alternatives(r"\b(?:hey|\w+)\b", "i") == () and alternatives(r"(?:yes|hello)?x", "i") == ()
    texts = ["It is IMPORTANT", "it is \u0130mportant", "it is \u0131mportant", "ask \u017forta", "\u212ainda", "plain", "no!!", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", folded(F.col("t")).alias("low"))
    for pattern in (*R.FORMAL_PATTERNS, *R.INFORMAL_PATTERNS):
        assert "contains(" in plan(rows.select(found(F.col("t"), pattern, "i", F.col("low"))))
        both = rows.select(hits(F.col("t"), pattern, "i", F.col("low")), hits(F.col("t"), pattern, "i")).collect()
        assert all(guarded == plain for guarded, plain in both), pattern


def test_masks_look_for_each_delimiter_once(spark):
    files = of(spark, 'a\n"""\nb\n\'\'\'\n"""\nc\n\'\'\'\nd\n\'\'\'', "x = 1")
    rows = masked_lines(files)
    assert [r["line_no"] for r in rows.where("in_docstring").orderBy("line_no").collect()] == [2, 3, 4, 5, 6, 7, 9]
    assert plan(rows).count("regexp_extract_all(") == 2


def test_allowed_numbers_leave_early(spark):
    rows = naming.magic_numbers(of(spark, "x = 0\ny = 0 + 37\n"))
    assert [(r["line_no"], r["number"]) for r in rows.collect()] == [(2, "37")]
    assert "exists(" in plan(rows)


@pytest.mark.parametrize("query", ["overall_confidence", "detailed_issues", "dependency_verdict", "batch_report", "critical_issues"])
def test_files_and_changes_are_derived_once(spark, small_tables, query):
    assert not [f for f in build_registry()[query](spark, small_tables).inputFiles() if "documents.parquet" in f]


def test_diffs_are_cut_once(spark):
    head = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1 +1,2 @@\n a\n+b"
    texts = [head, head + "\n", head + "\n\n", "noise\n" + head + "\n" + head.replace("x.py", "y.py") + "\n\n", head.replace("\n", "\r\n"),
             head.replace("+b", "+b c"), "diff --git ", "diff --git \ndiff --git a b\n", "no diff", "", None]
    rows = diffs.file_diffs(spark.createDataFrame(list(enumerate(texts)), "diff_id long, diff string"))
    got = {(r["diff_id"], r["file_no"]): (r["path"], [tuple(a) for a in r["added"]]) for r in rows.collect()}
    one = ("x.py", [(2, "b")])
    assert got == {(0, 0): one, (1, 0): one, (2, 0): one, (3, 0): one, (3, 1): ("y.py", [(2, "b")]), (4, 0): one, (5, 0): one,
                   (6, 0): ("", []), (7, 0): ("", []), (7, 1): ("b", [])}
    # The text is cut into sections and parts once, not at every use of the pieces.
    assert plan(rows).count("diff --git ") == 1 and plan(rows).count("(?=@@") == 1


def test_rules_are_asked_only_where_a_sign_stands(spark):
    assert signs(r"hashlib\.md5\s*\(") == ("(", ".") and signs("x|(y)") == () and signs(r"['\"]sk-") == ("\"'", "-")
    texts = ["x = hashlib.md5 (a)", "HASHLIB.MD5(a)", "hashlib.md5", "PRIVATE\u00a0KEY", "secret = 'abcdefgh\u017f'", "..//../x", "<!ENTITY x", "plain prose.", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("low", folded(F.col("t")))
    rules = [(r.pattern, f.flags) for f in security.S.FAMILIES for r in f]
    text, low = F.col("t"), F.col("low")
    for pattern, flags in rules:
        both = rows.select(found(text, pattern, flags, low, held_signs(text)).alias("a"), found(text, pattern, flags).alias("b"),
                           may_match(text, low, [(pattern, flags)]).alias("c")).collect()
        assert all(r["a"] == r["b"] and (r["c"] or not r["b"]) for r in both), pattern
    # Each step holds the tests of a few families, so that its method is compiled.
    steps = [line for line in plan(security.findings(of(spark, "a"))).splitlines() if "Generate inline" in line]
    assert max(sum(r.replace("\\", "") in s.replace("\\", "") for r, _ in rules) for s in steps) < 30


def test_random_calls_count_only_in_a_context(spark):
    rows = security.findings(of(spark, "token = random.choice(x)\ncolour = random.choice(x)\n"), (security.S.INSECURE_RANDOM,))
    assert [r["line_no"] for r in rows.collect()] == [1]
    assert [r["line_no"] for r in security.findings(of(spark, "a = 1\ncolour = random.choice(x)\nkey = rand(1)\n")).collect()] == [3]


def test_text_rules_look_in_folded_text(spark):
    assert lowered(r"(?is)Def\S+[A-Z]X", "") == (r"def\S+[a-z]x", "s")
    assert lowered("Abc", "") is None and lowered(r"(a)\1", "i") is None and lowered("[A-_]", "i") is None
    texts = ["RETURN 'Mock_x'", "return  [\u00a0]", "# TODO: F\u0130X", "re\u017ft of the file", "\u212aept", "x = 'Fa\u212ae'", "def Te\u017ft(", "none", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("low", folded(F.col("t")))
    for fam in stubs.S.FAMILIES:
        for r in fam:
            both = rows.select(likely(F.col("t"), r.pattern, fam.flags, F.col("low")), found(F.col("t"), r.pattern, fam.flags)).collect()
            assert all(a == b for a, b in both), r.pattern
