"""One very long line or file takes time linear in it, and the faster ways give what the plain ones give."""

import random
import re
import time

from codesieve.functions.blocks import next_similar, repeated_blocks, word_sets
from codesieve.functions.places import places_of
from codesieve.operators import emoji, metrics, naming
from codesieve.rulebook import emoji as E
from codesieve.sources.diffs import added_lines, file_diffs

N = 100_000


def test_places_match_a_plain_search():
    rng = random.Random(3)
    for _ in range(500):
        text = "".join(rng.choice("ab12_ ") for _ in range(rng.randrange(60)))
        names = re.findall(r"\b[a-z_][a-z0-9_]*\b", text) + ["absent9", "b2", "ab"]
        assert places_of(text, names) == [text.find(n) for n in names]
    assert places_of("", ["a1"]) == [-1] and places_of("a1", []) == []


def test_next_similar_matches_a_plain_search():
    rng = random.Random(5)
    for case in range(60):
        vocabulary = [f"w{i}" for i in range(rng.choice([3, 8, 40]))]
        norm = [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 6))) for _ in range(rng.randrange(4, 40))]
        if case % 2:
            norm += norm[:10]
        blocks = word_sets(norm, 4)
        want = []
        for i, a in enumerate(blocks):
            for j in range(i + 4, len(blocks)):
                similarity = len(set(a) & set(blocks[j])) / len(set(a) | set(blocks[j]))
                if similarity >= 0.8:
                    want.append((i, j, similarity))
                    break
        assert list(next_similar(blocks, 4, 0.8)) == want
    assert repeated_blocks(["a", "b"]) == [] and repeated_blocks([]) == []


def test_quoted_is_in_string(spark):
    rng = random.Random(7)
    lines = ["".join(rng.choices("ab'\"\\ ", k=rng.randrange(1, 16))) for _ in range(800)]
    lines = [line for line in lines if line.count("'") + line.count('"') < 4]
    rows = naming.with_quotes(spark.createDataFrame([(line,) for line in lines], "line string"))
    spots = rows.selectExpr("*", "explode(sequence(-1, length(line))) AS at")
    wrong = spots.where(~naming.quoted(spots["at"]).eqNullSafe(naming.in_string(spots["line"], spots["at"])))
    assert len(lines) > 400 and wrong.count() == 0


def _plain_context(line, before, language):
    if language == "python" and line.lstrip().startswith("#"):
        return "comment"
    if language == "python" and (before.count('"""') % 2 or before.count("'''") % 2):
        return "docstring"
    bare = re.sub(r"\"[^\"]*\"|'[^']*'", "", re.sub(r"\\[\s\S]", "", before))
    return "string" if re.search("[\"']", bare) or re.search(r"f[\"'][^\"']*$", before) else "code"


def test_emoji_contexts_match_the_prefix_rule(spark, code):
    rng = random.Random(11)
    signs = ["a", "f", " ", "\\", "'", '"', "'''", '"""', "\U0001f680", "✅", "#"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(1, 25))) for _ in range(600)]
    files = code(*[(f"{i}.x", ("python", "rust")[i % 2], t) for i, t in enumerate(texts)])
    got = sorted((r["path"], r["col_no"], r["context"]) for r in emoji.emoji_matches(files).collect())
    inside = lambda c: any(lo <= ord(c) <= hi for lo, hi in E.RANGES)
    assert got == sorted((f"{i}.x", at, _plain_context(t, t[:at], ("python", "rust")[i % 2]))
                         for i, t in enumerate(texts) for at, c in enumerate(t) if inside(c))


def test_hundred_thousand_names_on_one_line(spark, code):
    line = " ".join(f"value{i}" for i in range(N)) + " = data"
    start = time.time()
    rows = naming.generic_names(code(("a.py", "python", line), ("b.py", "python", "data " * N)))
    counts = {r["path"]: r["count"] for r in rows.groupBy("path").count().collect()}
    assert counts == {"a.py": N + 1, "b.py": N} and time.time() - start < 60
    assert rows.where("identifier = 'value99999'").first()["col_no"] == line.index("value99999")
    assert naming.name_overuse(code(("b.py", "python", "data " * N))).first()["uses"] == N


def test_hundred_thousand_emoji_and_quoted_numbers_on_one_line(spark, code):
    start = time.time()
    rows = emoji.emoji_matches(code(("a.py", "python", "x = '" + "\U0001f680 ok' + '" * N)))
    assert rows.where("context = 'string'").count() == N and time.time() - start < 60
    start = time.time()
    assert naming.magic_numbers(code(("a.py", "python", "x('a', " + "777 " * N + ")"))).count() == N and time.time() - start < 60


def test_hundred_thousand_similar_lines(spark, code):
    shared = " ".join(f"column_{k}" for k in range(40))
    start = time.time()
    rows = metrics.duplicate_blocks(code(("a.sql", "sql", "\n".join(f"insert {shared} values {i}" for i in range(N)))))
    # The last of N - 3 blocks takes no part, and the last four others have none after them.
    assert rows.count() == N - 8 and time.time() - start < 60


def test_overlapping_hunks_keep_the_later_line(spark):
    n = 20_000
    hunk = lambda start, sign, size: f"@@ -0,0 +{start},{size} @@\n" + "\n".join(f"+{sign}{i}" for i in range(size))
    diff = "diff --git a/f.py b/f.py\n--- a/f.py\n+++ b/f.py\n" + hunk(1, "old", n) + "\n" + hunk(n // 2 + 1, "new", n)
    start = time.time()
    rows = added_lines(file_diffs(spark.createDataFrame([(1, diff)], "diff_id long, diff string"))).orderBy("line_no").collect()
    want = [f"old{i}" for i in range(n // 2)] + [f"new{i}" for i in range(n)]
    assert [r["text"] for r in rows] == want and [r["line_no"] for r in rows] == list(range(1, len(want) + 1))
    assert time.time() - start < 60
