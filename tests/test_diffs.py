"""Diff parsing on edge cases, compared with a plain line-by-line reader."""

import random
import re

import pytest

from codesieve.operators import paths, review
from codesieve.sources.diffs import added_lines, file_diffs
from pyspark.sql import functions as F

HEAD = "diff --git a/{p} b/{p}\n--- a/{p}\n+++ b/{p}\n"


def parse(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "diff_id bigint, diff string")
    return file_diffs(df)


def added(spark, text):
    return {(r.path, r.line_no): r.text for r in added_lines(parse(spark, text)).collect()}


def brute(text):
    """Independent reader of added lines for one-file diffs."""
    out, old, new, at, path = {}, 0, 0, 0, None
    for raw in text.split("\n"):
        m = re.match(r"@@ -\d+(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", raw)
        if raw.startswith("diff --git "):
            path, old, new = raw.rsplit(" b/", 1)[1], 0, 0
        elif path and m:
            old, at, new = int(m[1] or 1), int(m[2]), int(m[3] or 1)
        elif path and (old > 0 or new > 0):
            if raw.startswith("+"):
                out[(path, at)] = raw[1:]
            if not raw.startswith(("-", "\\")):
                at, new = at + 1, new - 1
            if not raw.startswith(("+", "\\")):
                old -= 1
    return out


def test_statuses(spark):
    text = (HEAD.format(p="x.py") + "@@ -1 +1,2 @@\n a\n+b\n"
            "diff --git a/n.py b/n.py\nnew file mode 100644\n--- /dev/null\n+++ b/n.py\n@@ -0,0 +1 @@\n+x\n"
            "diff --git a/o.py b/o.py\ndeleted file mode 100644\n--- a/o.py\n+++ /dev/null\n@@ -1 +0,0 @@\n--- not a header\n"
            "diff --git a/r b/s\nrename from r\nrename to s\n"
            "diff --git a/i.png b/i.png\nBinary files a/i.png and b/i.png differ\n")
    rows = {r.path: (r.status, r.is_binary, len(r.added)) for r in parse(spark, text).collect()}
    assert rows == {"x.py": ("modified", False, 1), "n.py": ("added", False, 1), "o.py": ("deleted", False, 0),
                    "s": ("renamed", False, 0), "i.png": ("modified", True, 0)}


def test_trailing_removals_no_newline_and_crlf(spark):
    text = HEAD.format(p="x.py") + "@@ -3,2 +3,2 @@\r\n ctx\r\n+new\r\n--- old\r\n\\ No newline at end of file\r\n"
    assert added(spark, text) == {("x.py", 4): "new"}


def test_quoted_path(spark):
    text = 'diff --git "a/caf\\303\\251.py" "b/caf\\303\\251.py"\n--- "a/caf\\303\\251.py"\n+++ "b/caf\\303\\251.py"\n@@ -0,0 +1 @@\n+x\n'
    assert added(spark, text) == {("café.py", 1): "x"}


def test_garbage_gives_no_files(spark):
    assert parse(spark, "From: someone\n\nhello @@ -1 +1 @@\n+x\n").count() == 0


def test_seeded_fuzz_against_brute_force(spark):
    rng = random.Random(7)
    texts = []
    for n in range(60):
        rows = [HEAD.format(p=f"f{n}.py").rstrip("\n")]
        for _ in range(rng.randint(1, 3)):
            rows.append(f"@@ -{rng.randint(1, 9)},{rng.randint(0, 4)} +{rng.randint(1, 60)},{rng.randint(0, 5)} @@")
            rows += [rng.choice([" c", "+a", "-d", "", "\\ No newline", "+++ b/z", "--- a/z"]) + str(rng.randint(0, 99)) for _ in range(rng.randint(0, 8))]
        texts.append("\n".join(rows))
    got = {}
    for r in parse(spark, *texts).selectExpr("diff_id", "inline(added)").collect():
        got.setdefault(r.diff_id, {})[r.line_no] = r.text
    for n, text in enumerate(texts):
        want = {line: t for (_, line), t in brute(text).items()}
        assert got.get(n, {}) == want, text


@pytest.mark.parametrize("quoted,plain", [('"\\101b"', "Ab"), ("x/y", "x/y"), ('"t\\tn"', "t\tn"), ('"', '"'), ('"a\\qb"', "aqb")])
def test_unquote(spark, quoted, plain):
    df = spark.createDataFrame([(quoted,)], "p string")
    assert df.select(paths.unquote_path(F.col("p"))).first()[0] == plain


def test_policy_is_global_to_the_change(spark):
    body = "@@ -0,0 +1,6 @@\n" + "\n".join(f"+x{i} = {i}" for i in range(6)) + "\n"
    untested = HEAD.format(p="src/a.py") + body
    tested = untested + HEAD.format(p="tests/test_a.py") + "@@ -1 +1,2 @@\n a\n+b\n"
    df = spark.createDataFrame([(0, untested), (1, tested)], "diff_id bigint, diff string")
    assert [r.diff_id for r in review.policy_findings(review.reviewable(df)).collect()] == [0]
