"""Registered queries of the change review."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.operators import review
from codesieve.sources.diffs import added_lines, file_diffs
from codesieve.sources.rendered import code_files, diff_texts

EXCLUDE = ("src/core/*",)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.reviewable(diff_texts(spark, sf_dir), EXCLUDE)


def _rows(spark: SparkSession, sf_dir: str, mode: str = "warn") -> DataFrame:
    """Reviews with the new versions that are at hand; every third change has none and falls back to its hunks."""
    return review.reviewed(_files(spark, sf_dir), new_versions(spark, sf_dir).where("diff_id % 3 <> 2"), mode)


def new_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(diff_id, path, content)``: each change's file after the change."""
    d = F.col("doc_id")
    files = code_files(spark, sf_dir).withColumn("l", F.split("content", "\n"))
    is_new = d % 5 == 1
    kept = F.when(is_new, F.col("l")).otherwise(
        F.expr("filter(l, (x, i) -> (doc_id + i) % 3 != 2)"))
    filler = F.array_repeat(F.lit("# filler"), F.when(is_new, F.lit(0)).otherwise(d % 9).cast("int"))
    return files.select(d.alias("diff_id"), "path", F.array_join(F.concat(filler, kept), "\n").alias("content"))


def build() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    short = ("diff_id", "path", "line_no", "class", "finding", "severity")
    return {
        "parse_diff": lambda s, d: added_lines(file_diffs(diff_texts(s, d))).select("diff_id", "path", "line_no", "text"),
        "diff_files": lambda s, d: file_diffs(diff_texts(s, d)).select(
            "diff_id", "file_no", "path", "old_path", "status", "is_binary", F.size("added").alias("n_added")),
        "skip_reason": lambda s, d: _files(s, d).select("diff_id", "path", "language", "skip"),
        "map_fragment_lines": lambda s, d: review.review_findings(review.reviewed(_files(s, d), None, "off")).select(*short),
        "coverage_policy": lambda s, d: review.policy_findings(_files(s, d)).select(*short),
        "file_verdicts": lambda s, d: review.file_verdicts(_rows(s, d, "fail")),
        "engines_used": lambda s, d: review.engines_used(_rows(s, d)),
        "review_totals": lambda s, d: review.review_totals(_rows(s, d)),
        "attribute_findings": lambda s, d: review.attribution(_files(s, d), new_versions(s, d)),
        "report_annotations": lambda s, d: review.annotations(_rows(s, d)),
        "sarif_results": lambda s, d: review.sarif_results(review.review_findings(_rows(s, d))),
        "sarif_rules": lambda s, d: review.sarif_rules(review.review_findings(_rows(s, d))),
        "sarif_document": lambda s, d: review.sarif_documents(_rows(s, d)),
        "review_payload": lambda s, d: review.payload(_rows(s, d)),
        "report_text": lambda s, d: review.text_report(_rows(s, d)),
    }
