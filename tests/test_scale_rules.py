"""Texts that carry control characters, very long lines, large diffs: no cap and no in-band mark changes a result."""

import time

from codesieve.operators import corpus, emoji, gate, naming, review, stubs, wording
from codesieve.operators.lines import masked_lines
from codesieve.sources.diffs import added_lines, file_diffs

CONTROLS = [chr(i) for i in range(32) if chr(i) not in "\n\r\x0b\x0c\x1c\x1d\x1e\t\x1f"]


def test_control_characters_make_no_findings(spark, code):
    dirty = "def run():\n    return True\nvalue = 'mock_user'\n"
    rows = [(f"c{i}.py", "python", f"x = 1 {c}\ny = 2\n{c}z = 3\n") for i, c in enumerate(CONTROLS)]
    rows += [(f"d{i}.py", "python", f"# {c}\n{dirty}") for i, c in enumerate(["", *CONTROLS])]
    found = stubs.findings(code(*rows)).select("path", "line_no", "pattern_type").collect()
    assert not [r for r in found if r["path"].startswith("c")]
    per_file = {p: sorted((r["line_no"], r["pattern_type"]) for r in found if r["path"] == p) for p in {r[0] for r in rows if r[0][0] == "d"}}
    assert len({tuple(v) for v in per_file.values()}) == 1 and per_file["d0.py"]
    verdicts = gate.text_verdicts(code(*rows)).collect()
    assert {r["verdict"] for r in verdicts if r["path"].startswith("c")} == {"PASS"}


def test_marks_come_back_in_text(spark, code):
    content = "## A\x01b\nbody \x03 text\n```\n## no\x01\n```\n## C\nend"
    docs = code(("m.md", "markdown", content))
    assert [(r["heading"], r["body"]) for r in corpus.sections(docs, 2).orderBy("ord").collect()] == [("A\x01b", "body \x03 text\n```\n## no\x01\n```"), ("C", "end")]
    source = '"""doc \x01\nmore\x03"""\nx = 1  # note \x02 here\n'
    files = code(("a.py", "python", source))
    assert [r["line"] for r in masked_lines(files).orderBy("line_no").collect()] == source.split("\n")
    assert "\x02" in "".join(r["text"] for r in wording.comments(files).collect())


def test_hundred_thousand_numbers_on_one_line(spark, code):
    n = 100_000
    start = time.time()
    rows = naming.magic_numbers(code(("a.py", "python", "x(" + " ".join(["777"] * n) + ")")))
    assert rows.count() == n and time.time() - start < 60
    last = rows.orderBy(rows["col_no"].desc()).first()
    assert last["col_no"] == 2 + 4 * (n - 1)


def test_emoji_columns(spark, code):
    out = emoji.emoji_matches(code(("a.py", "python", "x = 1 # \U0001f680 go \U0001f680\n"))).orderBy("col_no").collect()
    assert [r["col_no"] for r in out] == [8, 13]


def test_large_diff_and_file(spark):
    n = 600_000
    added = "\n".join(f"+value_{i} = {i}  # line" for i in range(n))
    diff = f"diff --git a/big.py b/big.py\n--- a/big.py\n+++ b/big.py\n@@ -0,0 +1,{n} @@\n{added}"
    assert len(diff) > 10 * 1024 * 1024
    diffs = spark.createDataFrame([(1, diff), (2, "diff --git a/s.py b/s.py\n--- a/s.py\n+++ b/s.py\n@@ -0,0 +1,1 @@\n+x = 1")], "diff_id long, diff string")
    files = file_diffs(diffs)
    assert {r["diff_id"]: r["count"] for r in added_lines(files).groupBy("diff_id").count().collect()} == {1: n, 2: 1}
    content = "def run():\n    return True\n" + "# filler line\n" * 200_000
    small = spark.createDataFrame([(3, "diff --git a/f.py b/f.py\n--- a/f.py\n+++ b/f.py\n@@ -0,0 +1,2 @@\n+def run():\n+    return True")], "diff_id long, diff string")
    contents = spark.createDataFrame([(3, "f.py", content)], "diff_id long, path string, content string")
    out = review.attribution(review.reviewable(small), contents).collect()
    assert len(content) > 2_000_000 and [r["attributed"] > 0 for r in out] == [True]
