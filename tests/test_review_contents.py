"""Reviews of whole contents with fallback to hunks, intervals of added lines, reports and SARIF."""

import json
import random

import pytest
from pyspark.sql import functions as F

from codesieve.operators import review
from codesieve.plans import review_queries

HEAD = "diff --git a/{p} b/{p}\n--- a/{p}\n+++ b/{p}\n"


def change(path, added, at=1, removed=()):
    body = [f"-{r}" for r in removed] + [f"+{a}" for a in added]
    return HEAD.format(p=path) + f"@@ -{at},{len(removed)} +{at},{len(added)} @@\n" + "\n".join(body) + "\n"


def run(spark, diffs, contents=(), mode="off", **more):
    df = spark.createDataFrame(list(enumerate(diffs)), "diff_id bigint, diff string")
    held = spark.createDataFrame(list(contents), "diff_id bigint, path string, content string") if contents is not None else None
    return review.reviewed(review.reviewable(df), held, mode, **more)


OLD = "def old_stub():\n    pass  # TODO: implement later\n\n\ndef fresh(a, b):\n    return a + b\n"
CHANGES = [
    (change("svc/mod.py", ["def fresh(a, b):", "    return a + b"], 5), [("svc/mod.py", OLD)]),
    (change("svc/save.py", ["def save(record):", "    raise NotImplementedError"]), [("svc/save.py", "def save(record):\n    raise NotImplementedError\n")]),
    (change("a.py", ["x = 1", "def f():", "    raise NotImplementedError"], 40) + change("b.js", ["ok();"]), [("b.js", "ok();\n"), ("a.pyc", "no")]),
    (change("a.py", ["y = 2"]), [("b.js", "other")]),
    (change("n.md", ["## TODO: implement later"]) + change("a.py", ["# TODO: implement later"]), [("a.py", "# TODO: implement later\n" * 10)]),
]


@pytest.fixture(scope="module")
def reviewed(spark):
    contents = [(i, path, text) for i, (_, held) in enumerate(CHANGES) for path, text in held]
    return run(spark, [diff for diff, _ in CHANGES], contents, max_bytes=150)


@pytest.fixture(scope="module")
def by_file(reviewed):
    return {(r.diff_id, r.path): r for r in reviewed.collect()}


def test_whole_content_attributes_added_lines_only(by_file):
    r = by_file[0, "svc/mod.py"]
    assert (r.mode, r.verdict, r.found) == ("full", "PASS", []) and r.old_violations + r.old_warnings > 0


def test_whole_content_fails_on_an_added_violation(by_file, reviewed):
    assert by_file[1, "svc/save.py"].verdict == "FAIL"
    total = review.review_totals(reviewed).where("diff_id = 1").first()
    assert (total.verdict, total.pre_existing_violations, total.files_failed) == ("FAIL", 0, 1)


def test_files_without_content_fall_back_to_hunks(by_file):
    assert by_file[2, "a.py"].mode == "hunk" and by_file[2, "b.js"].mode == "full" and by_file[3, "a.py"].mode == "hunk"
    assert {f.line_no for f in by_file[2, "a.py"].found} == {41} and by_file[2, "a.py"].verdict == "FAIL"


def test_skips_and_oversized_contents(by_file):
    assert [(by_file[4, p].mode, by_file[4, p].verdict) for p in ("n.md", "a.py")] == [("skipped-not-code", "PASS"), ("skipped-oversized", "PASS")]


def test_report_names_modes_and_existing_findings(reviewed):
    text = review.text_report(reviewed).where("diff_id = 0").first().report
    assert "svc/mod.py [full] -> PASS" in text and "pre-existing=" in text and "pre-existing=0v/0w" not in text


def test_policy_joins_the_findings(spark):
    body = [f"x{i} = {i}" for i in range(6)]
    rows = run(spark, [change("src/a.py", body), change("src/a.py", body) + change("tests/test_a.py", ["b = 1"])], None, "fail").collect()
    assert {(r.diff_id, r.path, r.verdict, len(r.found)) for r in rows} == {(0, "src/a.py", "FAIL", 1), (1, "src/a.py", "PASS", 0), (1, "tests/test_a.py", "PASS", 0)}


def test_intervals_of_added_lines(spark):
    rng = random.Random(2)
    lists = [[], [7], list(range(3, 600)), sorted(rng.sample(range(1, 400), 150))]
    df = spark.createDataFrame([(i, [(n, "t") for n in x]) for i, x in enumerate(lists)], "id int, added array<struct<line_no:int,text:string>>")
    rows = review.line_runs(df).select("id", "added", "runs", F.transform(F.sequence(F.lit(0), F.lit(610)), lambda n: review.run_at(F.col("runs"), "first", n)).alias("at"))
    for r in rows.collect():
        lines = lists[r.id]
        assert [x.first + k for x in r.runs for k in range(x.size)] == lines and (r.id != 2 or len(r.runs) == 1)
        for n, run_ in enumerate(r.at):
            want = [x for x in r.runs if x.first <= n]
            assert run_ == (want[-1] if want else None)


def test_a_very_long_change_is_one_interval(spark):
    n = 60_000
    diff = change("big.py", [f"x{i} = {i}" for i in range(n - 1)] + ["# TODO: implement later"])
    r = run(spark, [diff], [(0, "big.py", "\n".join([f"x{i} = {i}" for i in range(n - 1)] + ["# TODO: implement later"]))]).first()
    assert r.mode == "full" and {f.line_no for f in r.found} == {n}


def test_sarif_document(spark):
    diffs = [change("a.py", ["def f():", "    raise NotImplementedError", "# left as an exercise"]), change("b.py", ["x = 1"]), change("c.py", ["# left as an exercise"])]
    docs = {r.diff_id: json.loads(r.document) for r in review.sarif_documents(run(spark, diffs)).collect()}
    assert len(docs) == 3 and docs[1]["runs"][0]["results"] == [] and docs[1]["runs"][0]["tool"]["driver"]["rules"] == []
    for i in (0, 2):
        one = docs[i]["runs"][0]
        rules = one["tool"]["driver"]["rules"]
        assert docs[i]["version"] == "2.1.0" and [r["id"] for r in rules] == sorted(r["id"] for r in rules) and one["results"]
        for result in one["results"]:
            assert rules[result["ruleIndex"]]["id"] == result["ruleId"] and result["properties"].get("cwe") in (None, *rules[result["ruleIndex"]]["properties"]["tags"])


def test_no_changes(spark):
    none = spark.createDataFrame([], "diff_id bigint, diff string")
    rows = review.reviewed(review.reviewable(none), None)
    for frame in (rows, review.review_totals(rows), review.annotations(rows), review.payload(rows), review.text_report(rows), review.sarif_documents(rows)):
        assert frame.collect() == []


def test_budget_of_inline_comments(spark):
    rows = run(spark, [change("a.py", ["# left as an exercise"] * 70)])
    assert [(r.inline, r.overflow) for r in review.payload(rows).collect()] == [(50, 20)]
    assert [(r.inline, r.overflow) for r in review.payload(rows, None).collect()] == [(70, 0)]


@pytest.mark.parametrize("key", ["report_text"])
def test_a_change_is_parsed_once_and_moved_twice(spark, key):
    plan = review_queries.build()[key](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # The documents are read for the changes and for the new versions; the files of a change meet once more, in the window.
    assert plan.count("diff --git ") <= 12 and plan.count("Window ") == 1
