"""Registered queries of the findings algebra, confidences and reports."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codesieve.operators import antipatterns, detectors, gate, reports, scoring, security, stubs
from codesieve.sources.rendered import code_files
from codesieve.sources.tables import kept

#: Detectors whose scores the registered scan combines: all phases.
SCAN_WEIGHTS = scoring.PHASE_WEIGHTS
REPORTED = (*scoring.WEIGHTS, "emoji")
THRESHOLD = 0.4


def _scores(files: DataFrame) -> DataFrame:
    return scoring.overall(files, SCAN_WEIGHTS)


def _summary(files: DataFrame) -> DataFrame:
    return scoring.scan_summary(_scores(files), THRESHOLD)


def _bins(files: DataFrame) -> DataFrame:
    s = F.round("score", 9)
    rows = scoring.confidence(files, "security")
    return rows.groupBy(scoring.confidence_level(s).alias("level"), scoring.risk_level(s).alias("risk"),
                        scoring.security_risk(s).alias("security_risk"), scoring.project_risk(s).alias("project_risk")) \
        .agg(F.count("*").alias("n"))


def _report_scores(files: DataFrame) -> DataFrame:
    rows = reports.analyzer_scores(scoring.phase_scores(files, REPORTED))
    return rows.select("analyzer", *[F.round(c, 9).alias(c) for c in ("average", "low", "high")], "weight")


def _explain(files: DataFrame) -> DataFrame:
    """Per file and type: the count and the lines of the first three examples."""
    order = Window.partitionBy("path", "finding_type").orderBy("line_no")
    shown = F.when(F.row_number().over(order) <= 3, F.col("line_no"))
    rows = security.findings(files).withColumn("shown", shown).groupBy("path", "finding_type").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list("shown")).alias("l"))
    return rows.select("path", "finding_type", "n", F.array_join("l", ",").alias("examples"))


def build() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    on = lambda operator: (lambda s, d: operator(code_files(s, d)))
    # Several detectors read the same files: these are rendered once, in parts of like size whatever the table's row groups.
    often = lambda operator: (lambda s, d: operator(kept(code_files(s, d, always=True), "files")))
    found = security.findings
    out = {
        "count_by_type": on(lambda f: scoring.count_by(found(f), "finding_type", "severity")),
        "cwe_distribution": on(lambda f: scoring.count_by(found(f), "cwe", "owasp")),
        "findings_grouping_sets": on(lambda f: scoring.grouping_counts(found(f))),
        "mock_summary": on(lambda f: scoring.severity_summary(stubs.findings(f))),
        "top_per_file": on(lambda f: scoring.top_per_file(found(f)).select("path", "line_no", "finding_type", "severity", "confidence", "rank")),
        "top_issues": on(lambda f: scoring.top_issues(found(f)).select("path", "line_no", "finding_type", "severity", "confidence")),
        "severity_bridge": on(lambda f: stubs.findings(f).groupBy("severity", F.col("confidence")).agg(F.count("*").alias("n"))
                              .withColumn("gate_severity", gate.gate_severity(F.col("severity"), F.col("confidence")))),
        "explain_file": on(_explain),
        "antipattern_categories": often(lambda f: scoring.count_by(antipatterns.all_findings(f), "antipattern", "category", "severity")),
        "confidence_bins": on(_bins), "report_scores": often(_report_scores),
        "overall_confidence": often(lambda f: _scores(f).select("path", F.round("confidence", 6).alias("confidence"), "level")),
        "threshold_filter": often(lambda f: _scores(f).where(F.col("confidence") >= THRESHOLD).select("path", "level")),
        "quick_scan": often(lambda f: detectors.Detectors().overall(f, detectors.QUICK).select("path", F.round("confidence", 6).alias("confidence"), "level")),
        "top_types": often(lambda f: reports.top_types(reports.issues(f))),
        "critical_issues": often(lambda f: reports.pressing(reports.issues(f))),
        "detailed_issues": often(reports.detailed_issues),
        "severity_totals": often(lambda f: reports.severity_totals(reports.issues(f))),
        "batch_report": often(reports.batch_report),
        "file_reports": often(lambda f: reports.file_reports(f).withColumn("confidence", F.round("confidence", 6))),
        "executive_summary": often(lambda f: reports.executive_summary(_scores(f), THRESHOLD)),
        "scan_summary": often(_summary),
        "quality_gates": often(lambda f: scoring.quality_gates(_summary(f))),
        "remediation": often(lambda f: scoring.remediation(_scores(f))),
    }
    for analyzer in (*scoring.WEIGHTS, "emoji"):
        out[f"confidence_{analyzer}"] = often(lambda f, a=analyzer: scoring.confidence(f, a).select("path", F.round("score", 6).alias("score")))
    return out
