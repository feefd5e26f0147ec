"""Repeated blocks are searched for as far as asked, and imports are read once."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from codesieve.functions import blocks
from codesieve.functions.text import escaped, matches, rx
from codesieve.operators import imports, spans
from codesieve.sources.rendered import code_files

#: The token pattern as it was, a character at a time.
PLAIN_TOKEN = (r"#[^\n]*+"
               r'|"""(?:\\[\s\S]|[^\\"]|"(?!""))*+(?:"""|\\?\z)?' r"|'''(?:\\[\s\S]|[^\\']|'(?!''))*+(?:'''|\\?\z)?"
               r'|"(?:\\[\s\S]|[^"\\\n])*+"?+' r"|'(?:\\[\s\S]|[^'\\\n])*+'?+")


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _plain(norm):
    window = lambda i: norm[i:i + 4]
    n = len(norm) - 3
    first = [next(j for j in range(n) if window(j) == window(i)) for i in range(n)]
    rows = [(first[i], i, 1.0) for i in range(n) if first[i] < i]
    words = [{w for line in window(i) for w in line.split(" ")} for i in range(max(n, 0))]
    for i in range(n - 1):
        rows += [(i, j, len(words[i] & words[j]) / len(words[i] | words[j])) for j in range(i + 4, n - 1)
                 if len(words[i] & words[j]) / len(words[i] | words[j]) >= 0.8][:1]
    return rows


def test_repeats_are_those_of_a_plain_search():
    rng = random.Random(9)
    for case in range(300):
        vocabulary = [f"w{i}" for i in range(rng.choice([3, 9, 60, 400]))]
        norm = [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 7))) for _ in range(rng.randrange(45))]
        norm += [line if rng.random() < 0.9 else "other" for line in norm[:rng.choice([0, 12])]]
        assert blocks.repeated_blocks(norm) == _plain(norm)
    assert () in blocks.word_sets([f"a{i} b{i} c" for i in range(9)], 4, 0.8)


def test_similar_blocks_are_not_searched_for_behind_enough_exact_ones(monkeypatch):
    monkeypatch.setattr(blocks, "word_sets", lambda *a: pytest.fail("not asked for"))
    found = blocks.each_repeat(["a", "b", "c", "d"] * 5)
    assert [next(found) for _ in range(5)] == [(0, 4, 1.0), (1, 5, 1.0), (2, 6, 1.0), (3, 7, 1.0), (0, 8, 1.0)]


def test_pieces_are_the_tokens_and_what_is_between(spark):
    rng = random.Random(2)
    signs = ["'", '"', "'''", '"""', "\\", "#", "\n", "a", "import x", " ", "$1", "\x01", "\U0001f600"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(25))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(escaped(F.col("t")).alias("t"))
    rows = rows.select(spans.pieces(F.col("t")).alias("p"), F.split("t", rx(PLAIN_TOKEN), -1).alias("o"), matches(F.col("t"), PLAIN_TOKEN).alias("i"))
    for r in rows.collect():
        assert r["p"][::2] == r["o"] and r["p"][1::2] == r["i"]


def test_names_are_read_once_and_looked_up_as_before(spark):
    names = spark.createDataFrame([("a.py", "python", "os", 1), ("a.py", "python", "yaml", 2), ("b.py", "python", "yaml", 3), ("c.js", "npm", "left-pad", 4),
                                   ("c.js", "npm", "fs", 5), ("d.py", "python", None, 6), ("d.py", None, "os", 7)], "path string, ecosystem string, name string, line_no int")
    registry = spark.createDataFrame([("python", "pyyaml", "exists"), ("npm", "left-pad", "unavailable"), ("npm", "left-pad", "exists")], "ecosystem string, name string, status string")
    rows = imports.classify(names, registry)
    assert plan(rows).count("LogicalRDD") == 3  # the names, and the registry for a name and for its alias
    assert sorted((r["path"], r["name"], r["status"]) for r in rows.collect()) == [
        ("a.py", "os", "stdlib"), ("a.py", "yaml", "exists-as"), ("b.py", "yaml", "exists-as"), ("c.js", "fs", "builtin"),
        ("c.js", "left-pad", "exists"), ("c.js", "left-pad", "unverifiable")]


def test_a_language_is_chosen_before_its_files_are_rendered(spark, tmp_path):
    spark.createDataFrame([(i, f"text {i}\n") for i in range(40)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    shown = plan(code_files(spark, str(tmp_path)).where("language = 'python'"))
    assert shown.index("Generate") < shown.index("Filter")


def test_python_imports_of_odd_hints_and_texts(spark):
    text = "import a.b, c\nx = 'import d'\nfrom e import f  # import g\nm = importlib.import_module('h.i')\n\"\"\"\nimport j\n\"\"\"\nimport k"
    files = spark.createDataFrame([("1", "python", text), ("2", " PY ", text), ("3", None, "def f(x):\n    import q\n"), ("4", "go", text), ("5", "python", None),
                                   ("6", "", "import r\n"), ("7", "python", "x = 1")], "path string, language string, content string")
    want = [(1, "a"), (1, "c"), (3, "e"), (4, "h"), (8, "k")]
    assert sorted((r["path"], r["line_no"], r["name"]) for r in imports.python_imports(files).collect()) == sorted(
        [(p, n, name) for p in "12" for n, name in want] + [("3", 2, "q"), ("6", 1, "r")])
