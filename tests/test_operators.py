"""Boundary cases of single operators, with expected values worked out by hand."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from codesieve.functions.literals import required
from codesieve.functions.text import glob_regex
from codesieve.operators import emoji, metrics, naming, requests, security, stubs, wording
from codesieve.operators.lines import masked_lines


def test_secret_value_is_hidden_and_test_values_pass(code):
    rows = security.findings(code(("a.py", "python", "password = 'hunter2xyz'\npassword = 'test-value'\n"))) \
        .where("finding_type = 'hardcoded_secret'").collect()
    assert [r.line_no for r in rows] == [1] and "hunter2" not in rows[0].context


def test_first_rule_wins_per_line(code):
    rows = security.findings(code(("a.py", "python", "eval(request.x)\n"))).where("finding_type = 'command_injection'").collect()
    assert [r.rule for r in rows] == ["eval_user_input"]


def test_comment_lines_are_skipped_by_language(code):
    files = code(("a.py", "python", "# hashlib.md5(x)\n"), ("a.js", "javascript", "# hashlib.md5(x)\n"))
    assert [r.path for r in security.findings(files).collect()] == ["a.js"]


def test_docstring_mask(code):
    text = 'x = 1\n"""doc\ninside\n"""\ny = 2\n"""one line"""\nz = 3'
    rows = masked_lines(code(("a.py", "python", text))).where("in_docstring").collect()
    assert sorted(r.line_no for r in rows) == [2, 3, 4, 6]


def test_block_comment_mask(code):
    text = "/* a\nb\n*/\nint x;\n/* c */\nint y;"
    rows = masked_lines(code(("A.java", "java", text))).where("in_docstring").collect()
    assert sorted(r.line_no for r in rows) == [1, 2, 3, 5]


@pytest.mark.parametrize("lines,found", [(50, 0), (51, 1), (101, 1)])
def test_long_functions(code, lines, found):
    rows = naming.long_functions(code(("a.py", "python", "def f():\n" + "    x()\n" * lines))).collect()
    assert len(rows) == found and all(r.severity == ("CRITICAL" if lines > 100 else "HIGH") for r in rows)


def test_match_lines_of_text_rules(code):
    text = "# FIXME a\nx = 1  # FIXME b  # FIXME c\n"
    rows = stubs.findings(code(("a.py", "python", text))).where("pattern_type = 'todo_fixme_marker'").collect()
    assert sorted(r.line_no for r in rows) == [1, 2, 2]


def test_duplicates_against_brute_force(code):
    rng = random.Random(3)
    texts = []
    for n in range(12):
        pool = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) + str(rng.randint(0, 2)) for _ in range(4)) for _ in range(6)]
        texts.append("\n".join(rng.choice(pool) for _ in range(rng.randint(8, 30))))
    files = code(*[(str(i), "python", t) for i, t in enumerate(texts)])
    got = {}
    for r in metrics.duplicate_blocks(files).collect():
        got.setdefault(r.path, []).append((r["rank"], r.start_a, r.start_b, round(r.similarity, 6)))
    for i, text in enumerate(texts):
        rows = text.split("\n")
        n, seen, out = len(rows), {}, []
        for a in range(n - 3):
            block = tuple(rows[a:a + 4])
            if block in seen:
                out.append((seen[block] + 1, a + 1, 1.0))
            seen.setdefault(block, a)
        sets = [set(" ".join(rows[a:a + 4]).split()) for a in range(n - 3)]
        for a in range(n - 4):
            for b in range(a + 4, n - 4):
                s = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                if s >= 0.8:
                    out.append((a + 1, b + 1, round(s, 6)))
                    break
        want = [(k + 1, *row) for k, row in enumerate(out)]
        assert sorted(got.get(str(i), [])) == want
    first = metrics.duplicate_blocks(files, top=5).groupBy("path").count().collect()
    assert {r.path: r["count"] for r in first} == {path: min(5, len(rows)) for path, rows in got.items()}


def test_nesting_is_clamped(code):
    rows = {r.path: (r.depth, r.line_no) for r in metrics.nesting(code(
        ("a.js", "javascript", "}}}\n{{\n{{{"), ("b.py", "python", "a\n        b\n    c"))).collect()}
    assert rows == {"a.js": (5, 3), "b.py": (2, 2)}


def test_inline_comment_outside_quotes(code):
    text = "x = '#no'  # yes\ny = \"unclosed # no\nz = 1 # two"
    assert {r.line_no: r.text for r in wording.comments(code(("a.py", "python", text))).collect()} == {1: "yes", 3: "two"}


def test_emoji_context(code):
    text = 's = "\U0001F680"\nrun() \U0001F389\n# ✨'
    rows = {r.line_no: (r.context, r.code_point) for r in emoji.emoji_matches(code(("a.py", "python", text))).collect()}
    assert rows == {1: ("string", "U+1F680"), 2: ("code", "U+1F389"), 3: ("comment", "U+2728")}


def test_frames_keep_three_invariants(spark):
    """Seeded fuzz: never an exception, silence only for notifications, ids echoed."""
    rng = random.Random(11)
    frames = []
    for i in range(300):
        frame = json.dumps({"jsonrpc": "2.0", "id": i, "method": rng.choice(["ping", "x", "initialize"]), "params": {}})
        for _ in range(rng.randint(0, 3)):
            cut = rng.randrange(len(frame))
            frame = frame[:cut] + rng.choice(['"', "{", "1", ",", ""]) + frame[cut + 1:]
        frames.append((i, frame))
    got = {r.seq: r for r in requests.responses(spark.createDataFrame(frames, "seq bigint, raw string")).collect()}
    for i, frame in frames:
        try:
            value = json.loads(frame)
        except ValueError:
            continue
        quiet = isinstance(value, dict) and value.get("jsonrpc") == "2.0" and isinstance(value.get("method"), str) and "id" not in value
        assert (i in got) == (not quiet), frame


def test_stream_gives_the_same_answers(spark, tmp_path):
    from codesieve.streaming.requests import answer

    rows = [(1, '{"jsonrpc":"2.0","id":1,"method":"ping"}'), (2, "!"), (3, '{"jsonrpc":"2.0","method":"ping"}')]
    df = spark.createDataFrame(rows, "seq bigint, raw string")
    df.write.json(str(tmp_path / "in"))
    answer(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    pick = lambda d: sorted(map(tuple, d.select("seq", "code", "id").collect()))
    assert pick(spark.read.parquet(str(tmp_path / "out"))) == pick(requests.responses(df))


@pytest.mark.parametrize("text", ["catch {/*" * 20000, '"' * 40000, "def f(" * 20000, "`" + "a\\" * 30000, "( " * 50000, "#" * 50000])
def test_hostile_texts_finish(code, text):
    from codesieve.operators import gate

    start = time.time()
    gate.text_verdicts(code(("a.js", "javascript", text))).collect()
    assert time.time() - start < 60


def test_guards_are_part_of_every_match():
    assert required(r"left\s+as\s+an\s+exercise", "i") == (True, ("exercise", "left"))
    assert required(r"(?:a|b)c?", "") == (False, ())


def test_glob_star_crosses_folders(spark):
    df = spark.createDataFrame([("tests/a/b.py",), ("xtests/a",)], "p string")
    assert [r[0] for r in df.select(F.col("p").rlike(glob_regex("tests/*"))).collect()] == [True, False]
