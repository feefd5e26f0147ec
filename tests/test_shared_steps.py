"""Steps that several rules read are found once, and verdicts don't repeat what they rest on."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from codesieve.functions.text import strip, strip_each
from codesieve.operators import architecture, metrics, scoring, wording
from codesieve.rulebook import style as R
from codesieve.sources.rendered import code_files

FILES = "path string, language string, content string"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def files(spark):
    text = "import os\n# TODO: first\nclass A(Base):\n    def run(self, a, b):\n        if a and b:\n            return run(a)\n" + "leverage the robust data\n" * 9
    return spark.createDataFrame([("a.py", "python", text), ("b.js", "javascript", text), ("c.py", "python", ""), ("d.py", "python", None)], FILES)


def test_a_filter_on_the_verdict_reads_the_text_once(spark, files):
    flagged = lambda rows: plan(rows.where("severity is not null"))
    assert flagged(metrics.ngram_repetition(files)).count("regexp_extract_all(") == 1
    assert flagged(metrics.maintainability(files)).count("regexp_extract_all(") == 2  # tokens, and the count of decision words
    assert flagged(wording.vocabulary(files)).count("Contains(") == len(R.MACHINE_VOCABULARY) + len(R.HUMAN_VOCABULARY)


@pytest.mark.parametrize("analyzer, step, module", [
    ("pattern", "ngram_scores", metrics), ("pattern", "token_entropies", metrics), ("statistical", "cognitive_segments", metrics),
    ("statistical", "halstead_counts", metrics), ("architectural", "python_classes", architecture), ("architectural", "imports", architecture),
    ("comment", "comments", wording)])
def test_a_detector_makes_each_step_once(files, monkeypatch, analyzer, step, module):
    plain, calls = getattr(module, step), []
    monkeypatch.setattr(module, step, lambda *a, **k: calls.append(step) or plain(*a, **k))
    rows = scoring.confidence(files.where("content is not null"), analyzer)
    assert len(calls) == 1 and rows.count() == 3


def test_shared_steps_give_the_same_findings(files):
    pairs = [(metrics.ngram_repetition, metrics.ngram_scores), (metrics.token_entropy, metrics.token_entropies),
             (metrics.cognitive, metrics.cognitive_segments), (metrics.cognitive_hotspots, metrics.cognitive_segments),
             (metrics.maintainability, metrics.maintainability_scores)]
    for operator, step in pairs:
        assert sorted(map(str, operator(files).collect())) == sorted(map(str, operator(files, step(files)).collect()))


def test_strip_each_is_strip(spark):
    texts = ["", " ", "a", " a", "a ", "\t a b\r\n", "\x0b\x0ca\x0b", "\u00a0a\u00a0", None, "a\u2003", " \n\t"]
    row = spark.createDataFrame([(texts,)], "t array<string>").select(strip_each(F.col("t")).alias("a"), F.transform("t", strip).alias("b")).first()
    assert row["a"] == row["b"] and row["a"][5] == "a b"


def test_rendered_files_are_dealt_out(spark, tmp_path):
    spark.createDataFrame([(i, f"text {i}\n") for i in range(400)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    dealt = code_files(spark, str(tmp_path), always=True)
    assert "RepartitionByExpression" in plan(dealt) and "RepartitionByExpression" not in plan(code_files(spark, str(tmp_path)))
    assert sorted(dealt.collect()) == sorted(code_files(spark, str(tmp_path)).collect())
