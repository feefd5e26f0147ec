"""Counts over token arrays against plain Python."""

from __future__ import annotations

import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codesieve.functions import tokens as K
from codesieve.operators import antipatterns, architecture, detect, metrics, naming, scoring, security, wording
from codesieve.rulebook import grammar as G
from codesieve.rulebook import style as R

FILES = "path string, language string, content string"


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(4)
    words = [f"w{k}" for k in range(40)] + ["self", "if", "_a", "9x", "+=", "(", "é"]
    return [None, [], ["a"], ["a", "a"], ["a", "b", "a"]] + [[pick.choice(words) for _ in range(pick.randint(0, 90))] for _ in range(60)] + [
        [pick.choice(words) for _ in range(3000)]]


@pytest.mark.parametrize("part", [1, 50, 1 << 16])
def test_counts_are_those_of_plain_sets(rows, monkeypatch, part):
    monkeypatch.setattr(K, "PART", part)
    given = pa.array(rows, pa.list_(pa.string()))
    for t, grams, ops, names in zip(rows, *(f(given).to_pylist() for f in (K.gram_counts, K.operator_counts, K.identifier_counts))):
        if t is None:
            assert grams is ops is names is None
            continue
        assert grams == {"u2": len(set(zip(t, t[1:]))), "u3": len(set(zip(t, t[1:], t[2:])))}
        o = [w for w in t if w in G.HALSTEAD_OPERATORS]
        d = [w for w in t if w not in G.HALSTEAD_OPERATORS and w[0].isascii() and (w[0].isalpha() or w[0] == "_")]
        assert ops == {"n1": len(set(o)), "n2": len(set(d)), "big_n1": len(o), "big_n2": len(d)}
        known = Counter(w for w in t if w not in R.ENTROPY_STOP_TOKENS)
        assert names == {"n": known.total(), "names": " ".join(sorted(known)), "counts": [known[w] for w in sorted(known)]}


def test_triples_that_fit_no_number_are_counted_by_their_pairs(rows):
    many = [f"t{k}" for k in range(2_200_000)]  # 2.2 million cubed is over 2 ** 63
    got = K.gram_counts(pa.array([many + many[:9], ["a", "b", "a", "b", "a"]])).to_pylist()
    assert got == [{"u2": len(many), "u3": len(many)}, {"u2": 2, "u3": 2}]


def test_texts_of_one_path_share_their_entropy(spark):
    a, b = " ".join(f"a{k % 7}" for k in range(40)), " ".join(f"a{k % 5}" for k in range(35))
    got = {r["path"]: r["entropy"] for r in metrics.token_entropies(spark.createDataFrame(
        [("p.py", "python", a), ("p.py", "python", b), ("q.py", "python", a), ("r.py", "python", "few"), ("s.py", "python", None)], FILES)).collect()}
    plain = lambda text: -sum(c / len(text.split()) * math.log2(c / len(text.split())) for c in Counter(text.split()).values())
    assert got["p.py"] == pytest.approx(plain(f"{a} {b}")) and got["q.py"] == pytest.approx(plain(a)) and got["r.py"] == got["s.py"] == 5.0


def test_counting_steps_call_no_lambda_per_token(spark):
    files = spark.createDataFrame([("a.py", "python", "a b c")], FILES)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for rows in (metrics.ngram_scores(files), metrics.halstead_counts(files)):
        assert "lambdafunction" not in plan(rows) and plan(rows).count("regexp_extract_all(") == 1


def test_generated_methods_stay_small_enough_to_be_compiled(spark):
    """The JVM leaves methods of more than 8,000 bytes to its interpreter."""
    import re

    files = spark.createDataFrame([("a.py", "python", "a b c")], FILES)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for rows in (security.findings(files), naming.code_identifiers(files), naming.magic_numbers(files), naming.verbose_comments(files),
                     wording.writing_style(files), wording.comment_phrases(files), antipatterns.feature_flags(files)):
            text = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(rows._jdf.queryExecution().executedPlan())
            sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
            assert sizes and max(sizes) <= 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_rule_asked_in_parts_is_the_first_that_matches(spark):
    rows = spark.createDataFrame([("# " + text,) for text in ("we note that this is so", "in order to", "nothing", "as noted, in order to")], "line string")
    rows = rows.withColumn("low", F.lower("line"))
    whole = rows.withColumn("i", R.COMMENT_PHRASES.first_match(F.col("line"), low=F.col("low"))).where("i is not null")
    assert sorted(detect.first_rule(rows, R.COMMENT_PHRASES).collect()) == sorted(whole.collect()) and whole.count() == 3


def test_one_pass_over_the_antipattern_texts_finds_what_four_find(spark):
    text = "class IThing(ABC):\n    pass\ndef f(a):\n    pass\n# TODO: remove unused\n_cache = {}\nfrom abc import ABC\nx = 1 << 3\n"
    files = spark.createDataFrame([("a.py", "python", text), ("b.py", "python", "def g(a):\n    pass\n"), ("c.py", "python", None)], FILES)
    every = [f(files) for f in (antipatterns.over_engineering, antipatterns.dead_code, antipatterns.premature_optimization, antipatterns.abstraction)]
    assert sorted(map(str, antipatterns.gold_plating(files).collect())) == sorted(str(r) for rows in every for r in rows.collect()) != []


def test_sections_are_cut_once_for_three_rules(spark, monkeypatch):
    plain, calls = metrics.segments, []
    monkeypatch.setattr(metrics, "segments", lambda *a, **k: calls.append(1) or plain(*a, **k))
    files = spark.createDataFrame([("a.py", "python", "def run(a):\n" + "    if a and b or c:\n        run(a)\n" * 9)], FILES)
    assert scoring.evidence(files, "statistical").where("kind = 'cyclomatic_complexity'").count() == 1 and len(calls) == 1
