"""Registered queries of Python's strings, docstrings and comments, and of the gate that knows them."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.operators import gate, spans
from codesieve.sources.python_texts import python_texts
from codesieve.sources.rendered import code_files
from codesieve.sources.tables import table


def _of_kind(files: DataFrame, *kinds: str) -> DataFrame:
    rules = [r for r in gate.gate_rules() if r.kind in kinds]
    return gate.listed(gate.collected(files, rules=rules)).select("path", "line_no", "class", "finding", "severity", "source", "cwe")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived files whose documents are labelled; those of poor quality are expected to fail."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_id"), (F.col("quality") == 0).alias("expected"))
    files = code_files(spark, sf_dir)
    return files.join(labels, files.doc_id == labels.label_id)


def build() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    on = lambda operator: (lambda s, d: operator(python_texts(s, d)))
    return {
        "string_spans": on(lambda f: spans.tokens(f).where("kind <> 'comment'")),
        "python_or_not": on(lambda f: f.select("path", F.coalesce(spans.is_python(F.col("language"), F.col("content")), F.lit(False)).alias("python"))),
        "suppress_in_strings": on(lambda f: _of_kind(f, *gate.G.SUPPRESSIBLE)),
        "verify_docstrings": on(lambda f: _of_kind(f, gate.G.DOCSTRING_RULE)),
        "suppress_commented": on(lambda f: _of_kind(f, gate.G.TYPED_EXCEPT[0])),
        "rule_benchmark": lambda s, d: gate.rule_benchmark(_judged(s, d)),
        "gate_findings": lambda s, d: gate.findings(code_files(s, d)),
        "gate_verdicts": lambda s, d: gate.file_verdicts(code_files(s, d)),
    }
