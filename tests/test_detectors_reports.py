"""Plug-in detectors with isolated faults, reports, bytes, section lookups and order-independent sums."""

import json

import pytest
from pyspark.sql import functions as F

from codesieve.operators import binaries, corpus, detectors, gate, reports, scoring
from codesieve.plans.file_queries import build as file_queries

FILES = [("a.py", "python", "def f():\n    raise NotImplementedError\npassword = 'hunter2xyz'\n"), ("b.js", "javascript", "eval(user_input)\n"), ("c.py", "python", ""), ("d.py", "python", None)]


def test_a_failing_plug_in_scores_zero_and_keeps_the_others(code):
    files = code(*FILES[:3])
    known = detectors.Detectors({"security": 0.2})

    def picky(path, language, content):
        if path == "b.js":
            raise ValueError("not mine")
        return [("HIGH", 0.8)] if "raise" in content else []

    known.register("picky", detectors.rowwise(picky), 0.1, size=1)
    known.register("unplannable", lambda f: f.select("no_such_column"), 0.3)
    known.register("lacking", lambda f: f.select("path"), 0.1)
    rows = {(r.path, r.analyzer): r for r in known.scores(files).collect()}
    assert len(rows) == 3 * 4 and all(r.score == 0 and r.error for k, r in rows.items() if k[1] in ("unplannable", "lacking"))
    assert rows["b.js", "picky"].error == "ValueError: not mine" and rows["b.js", "picky"].score == 0
    assert rows["a.py", "picky"].score == pytest.approx(0.75 * 0.8 / 4) and rows["a.py", "picky"].error is None
    alone = {r.path: r.score for r in scoring.confidence(files, "security").collect()}
    assert all(rows[p, "security"].score == s for p, s in alone.items()) and alone["a.py"] > 0
    total = {r.path: r for r in known.overall(files).collect()}
    assert total["b.js"].failed == ["lacking", "picky", "unplannable"] and total["b.js"].confidence == pytest.approx(alone["b.js"] * 0.2 / 0.7)
    assert [r.analyzer for r in known.scores(files.limit(1), ["picky"]).collect()] == ["picky"]
    with pytest.raises(ValueError):
        known.scores(files, ["nobody"])
    with pytest.raises(ValueError):
        known.register("weightless", lambda f: f, 0)


def test_sums_do_not_depend_on_partitions(spark):
    files = spark.createDataFrame([(f"f{i}.py", "python", "x = 'mock_user'\n# TODO: implement it\ndef f():\n    return True\n" * (1 + i % 7) + "y = 1\n" * (i % 5)) for i in range(40)],
                                  "path string, language string, content string")
    one, many = (sorted(map(tuple, scoring.confidence(files.repartition(n), "mock").collect())) for n in (1, 64))
    assert one == many


def test_reports(code):
    files = code(*FILES[:3])
    found = reports.issues(files)
    detailed = reports.detailed_issues(files, around=1).collect()
    assert len(detailed) == found.count() and all("hunter2xyz" not in r.code_snippet for r in detailed)
    assert any(">>>    2 |     raise NotImplementedError" in r.code_snippet or ">>>    1 | def f():" in r.code_snippet for r in detailed)
    assert reports.severity_totals(found).first().total == len(detailed)
    worst = [(r.severity, r.confidence) for r in reports.worst_first(found, k=3).collect()]
    assert len(worst) == 3 and worst == sorted(worst, key=lambda w: (scoring.RANK[w[0]], -w[1]))
    assert all(r["rank"] <= 1 for r in reports.top_types(found, 1).collect())
    body = {r.section: json.loads(r.body) for r in reports.batch_report(files, {"security": 0.6, "mock": 0.4}).collect()}
    assert body["summary"]["total_files"] == 3 and [a["analyzer"] for a in body["analyzer_scores"]] == ["mock", "security"]
    assert all(i["message"] for i in body["critical_issues"] + body["high_issues"]) and body["recommendations"]
    none = files.limit(0)
    assert reports.detailed_issues(none).collect() == []
    body = {r.section: json.loads(r.body) for r in reports.batch_report(none, {"mock": 1.0}).collect()}
    assert body["summary"]["total_files"] == 0 and body["critical_issues"] == [] and len(body["recommendations"]) == 1


def test_rule_benchmark_scores_every_set_of_engines(code):
    files = code(("a", "python", "# left as an exercise\n"), ("b", "javascript", "function f() {\n}\n"), ("c", "python", "x = 1\n"), ("d", "python", "def f():\n    raise NotImplementedError\n"))
    rows = gate.rule_benchmark(files.withColumn("expected", F.when(F.col("path") == "c", F.lit(False)).when(F.col("path") == "d", F.lit(None)).otherwise(F.lit(True)))).collect()
    by = {r.engines: (r.n_files, r.caught, r.missed, r.false_alarms, r.passed) for r in rows}
    assert len(by) == 15 and by["prose"] == (3, 1, 1, 0, 1) and by["structure"] == (3, 1, 1, 0, 1) and by["prose,structure"] == (3, 2, 0, 0, 1) and by["stubs"] == (3, 0, 2, 0, 1)


RAW = [("a.py", b"plain\r\ntext\rend"), ("b.py", b"\xef\xbb\xbfm\xc3\xa9"), ("c.py", b"\xff\xfeh\x00i\x00"), ("d.py", b"\xfe\xff\x00h\xd8\x34\xdd\x1e"), ("e.py", "caf\xe9 au lait!".encode("latin-1")),
       ("f.py", b"\x7fELF\x01"), ("g.py", b"\x00\x01\x02abc"), ("h.png", b"text"), ("i.py", b""), ("j.py", None), ("k.py", b"\xff\xfe\x34\xd8"), ("l.py", b"a" * 600 + b"\x00" * 4000), ("m.py", bytes(range(128, 160)) * 9)]


def test_bytes(spark):
    files = spark.createDataFrame(RAW, "path string, bytes binary")
    reason = {r.path: r.reason for r in binaries.sniffed(files).collect()}
    assert (reason["f.py"], reason["g.py"], reason["h.png"], reason["j.py"], reason["m.py"]) == ("signature", "control", "extension", "unreadable", "encoding")
    assert [reason[p] for p in ("a.py", "b.py", "e.py", "i.py", "l.py")] == [None] * 5
    assert {r.path: r.reason for r in binaries.sniffed(files, None).collect()}["l.py"] == "control"
    text = {r.path: (r.encoding, r.content) for r in binaries.decoded(files).collect()}
    assert text["a.py"] == ("utf-8", "plain\ntext\nend") and text["b.py"] == ("utf-8", "m\xe9") and text["c.py"] == ("utf-16", "hi") and text["d.py"] == ("utf-16", "h\U0001d11e")
    assert text["e.py"] == ("latin-1", "caf\xe9 au lait!") and text["i.py"] == ("utf-8", "") and text["j.py"] == (None, None) and text["k.py"][0] == "latin-1"
    assert binaries.decoded(files.limit(0)).collect() == []


def test_file_info_reads_no_contents(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.py").write_bytes(b"x = 1\n" * 300)
    (tmp_path / "b.xyz").write_bytes(b"?")
    info = binaries.file_info(spark, str(tmp_path))
    rows = {r.name: r for r in info.collect()}
    assert (rows["a.py"].extension, rows["a.py"].language, rows["a.py"].size_bytes, rows["a.py"].size_kb, rows["a.py"].is_supported) == (".py", "python", 1800, 1.76, True)
    assert rows["b.xyz"].is_supported is False and [r.name for r in binaries.file_info(spark, str(tmp_path), "*.py").collect()] == ["a.py"]
    assert "content" not in info._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    assert [(r.language, r.encoding) for r in binaries.text_files(spark, str(tmp_path), "*.py").collect()] == [("python", "utf-8")]
    assert set(file_queries()) == {"binary_sniff", "decode_chain", "file_info"}


def test_section_lookup(spark):
    text = "## PREAMBLE - why\nfirst\n## PART VI - together\nbody\n```\n## PART IX - not this\n```\n"
    docs = spark.createDataFrame([("m.md", text), ("empty.md", ""), ("null.md", None)], "path string, content string")
    asked = spark.createDataFrame([("m.md", "hive-mind"), ("m.md", "preamble"), ("m.md", "power-of-10"), ("m.md", "odd"), ("m.md", "full"), ("m.md", None), ("no.md", "toc"), ("empty.md", "preamble")],
                                  "path string, section string")
    got = {(r.path, r.section): (r.status, r.text) for r in corpus.look_up(docs, asked).collect()}
    assert got["m.md", "hive-mind"] == ("found", "## PART VI - together\n\nbody\n```\n## PART IX - not this\n```") and got["m.md", "preamble"] == ("found", "## PREAMBLE - why\n\nfirst")
    assert got["m.md", "power-of-10"] == ("missing", None) and got["m.md", "odd"] == ("unknown", None) and got["m.md", "full"] == ("found", text)
    status, toc = got["m.md", None]
    assert status == "found" and "- consensus-protocol: PART VI - together" in toc and "- power-of-10: PART IX" in toc and toc.endswith("## PREAMBLE - why\n\nfirst") and "hive-mind" not in toc
    assert got["no.md", "toc"] == ("no-document", None) and got["empty.md", "preamble"] == ("missing", None)
