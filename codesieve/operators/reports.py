"""Reports over all findings: issues with their code, top lists, and nested documents of bounded size.

Everything that goes into one document is bounded: counts by detector and type, and lists of k rows. Lists are taken with
``orderBy().limit(k)``, of which each task keeps k rows and the driver's side merges k per task; no window sees all rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesieve.functions.frames import settled
from codesieve.operators import antipatterns, paths, scoring, security, stubs
from codesieve.sources.tables import kept

ISSUE = ("path", "analyzer", "line_no", "kind", "severity", "confidence", "message", "suggestion")
#: Issues of each severity that a document lists.
LISTED = 20
QUOTED = "[\"'][^\"']*[\"']"


def issues(files: DataFrame) -> DataFrame:
    """``(path, analyzer, line_no, kind, severity, confidence, message, suggestion)`` of the detectors whose findings have lines."""
    tag = lambda rows, name, kind, message, suggestion: rows.select(
        "path", F.lit(name).alias("analyzer"), "line_no", F.col(kind).alias("kind"), "severity", "confidence", F.col(message).alias("message"), suggestion.alias("suggestion"))
    return reduce(lambda a, b: a.unionByName(b), [
        tag(security.findings(files), "security", "finding_type", "rule", F.col("suggestion")),
        tag(stubs.findings(files), "mock", "pattern_type", "description", F.col("suggestion")),
        tag(antipatterns.all_findings(files), "antipattern", "antipattern", "subcategory", F.lit(""))])


def detailed_issues(files: DataFrame, around: int = 3) -> DataFrame:
    """Issues with the lines around them, ``around`` on either side; what a line with a hardcoded secret quotes is masked.

    A file's issues are gathered before they meet its text, so the text moves once, not once for each issue.
    """
    found = issues(files)
    gathered = found.groupBy("path").agg(F.collect_list(F.struct(*[c for c in ISSUE if c != "path"])).alias("issues"))
    texts = files.select(F.col("path").alias("_path"), F.split("content", "\n", -1).alias("_lines"))
    rows = gathered.join(texts, F.col("path") == F.col("_path"))
    secret = F.transform(F.filter("issues", lambda i: i["kind"] == security.S.HARDCODED_SECRET.name), lambda i: i["line_no"])
    masked = F.transform("_lines", lambda line, i: F.when(F.array_contains("_secret", i + 1), F.regexp_replace(line, QUOTED, "***")).otherwise(line))
    rows = settled(rows.select("path", "issues", "_lines", secret.alias("_secret")))
    rows = settled(rows.withColumn("_lines", F.when(F.size("_secret") > 0, masked).otherwise(F.col("_lines"))))
    coded = F.transform("issues", lambda i: i.withField("code_snippet", paths.snippet(F.col("_lines"), i["line_no"], around)))
    return rows.select("path", F.inline(coded))


def severity_totals(found: DataFrame) -> DataFrame:
    """One row: all issues and those of each severity."""
    n = lambda s: F.count_if(F.col("severity") == s).alias(s.lower())
    return found.agg(F.count("*").alias("total"), *[n(s) for s in scoring.RANK])


def worst_first(found: DataFrame, severity: str | None = None, k: int = LISTED) -> DataFrame:
    """The first k issues by severity, confidence, place and kind; with a severity, of that one only."""
    rows = found if severity is None else found.where(F.col("severity") == severity)
    return rows.orderBy(scoring.severity_rank(F.col("severity")), F.desc("confidence"), "path", "line_no", "analyzer", "kind", "message").limit(k)


def pressing(found: DataFrame) -> DataFrame:
    """The first critical issues and the first of high severity; the issues are found once."""
    found = kept(found, "issues")
    return worst_first(found, "CRITICAL").unionByName(worst_first(found, "HIGH"))


def top_types(found: DataFrame, k: int = 5) -> DataFrame:
    """``(analyzer, rank, kind, n)``: each detector's commonest types. Types are few once counted."""
    counts = found.groupBy("analyzer", "kind").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("analyzer").orderBy(F.desc("n"), "kind"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k).select("analyzer", "rank", "kind", "n")


def analyzer_scores(scores: DataFrame, weights: dict[str, float] = scoring.REPORT_WEIGHTS) -> DataFrame:
    """``(analyzer, average, low, high, weight)``; averages are sums of whole units, the same in any order."""
    units = F.sum(F.round(F.col("score") * scoring.UNITS).cast("long")) / (F.count("*") * scoring.UNITS)
    rows = scores.groupBy("analyzer").agg(units.alias("average"), F.min("score").alias("low"), F.max("score").alias("high"))
    return rows.withColumn("weight", scoring.lookup(F.col("analyzer"), weights, 0.0))


def recommendations(average: Column, critical: Column, high: Column, antipattern: Column) -> Column:
    """Advice of a report, in order; never empty."""
    told = F.array_compact(F.array(
        F.when(critical > 0, F.concat(F.lit("Mend the "), critical.cast("string"), F.lit(" critical issue(s) first"))),
        F.when(high > 10, F.lit("Plan time for the issues of high severity")),
        F.when(antipattern > 0, F.lit("Look at the antipatterns, the commonest first")),
        F.when(average >= 0.55, F.lit("Have a second person read the files of high confidence"))))
    return F.when(F.size(told) > 0, told).otherwise(F.array(F.lit("Nothing pressing was found")))


def _section(rows: DataFrame, name: str, order: int, body: Column) -> DataFrame:
    return rows.select(F.lit(order).alias("order"), F.lit(name).alias("name"), body.alias("body"))


def batch_report(files: DataFrame, weights: dict[str, float] = scoring.REPORT_WEIGHTS) -> DataFrame:
    """``(section, body)``: the parts of a batch report as JSON, in place of one document that grows with the files.

    Sections: summary (files, lines, languages, overall confidence, risk), analyzer_scores, antipattern_summary,
    critical_issues and high_issues (at most LISTED each), recommendations. The report's file list is ``file_reports``.
    """
    # Four sections read the issues and two the scores: both are found once.
    found = kept(issues(files), "issues")
    digits = lambda c: F.round(c, 6)
    languages = files.groupBy("language").agg(F.count("*").alias("n"), F.sum(F.size(F.split("content", "\n", -1))).alias("lines"))
    scores = kept(analyzer_scores(scoring.phase_scores(files, weights), weights), "scores")
    # One row per detector, language or severity from here on.
    facts = scores.select(F.lit("score").alias("what"), F.col("analyzer").alias("name"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("lines"),
                          F.round(F.round("average", 9) * F.col("weight") * scoring.UNITS).cast("long").alias("part"))
    facts = facts.unionByName(languages.select(F.lit("language").alias("what"), F.col("language").alias("name"), "n", "lines", F.lit(0).cast("long").alias("part")))
    facts = facts.unionByName(found.groupBy("severity", "analyzer").agg(F.count("*").alias("n")).select(
        F.when(F.col("analyzer") == "antipattern", F.lit("antipattern")).otherwise(F.lit("issue")).alias("what"), F.col("severity").alias("name"), "n", F.lit(0).cast("long").alias("lines"), F.lit(0).cast("long").alias("part")))
    of = lambda what, value, more=F.lit(True): F.coalesce(F.sum(F.when((F.col("what") == what) & more, F.col(value))), F.lit(0))
    any_issue = lambda severity: F.coalesce(F.sum(F.when(F.col("what").isin("issue", "antipattern") & (F.col("name") == severity), F.col("n"))), F.lit(0))
    whole = facts.agg(of("language", "n").alias("total_files"), of("language", "lines").alias("total_lines"), (F.sum("part") / scoring.UNITS).alias("overall"),
                      F.array_sort(F.collect_list(F.when(F.col("what") == "language", F.struct(F.coalesce("name", F.lit("unknown")).alias("language"), F.col("n").alias("n"))))).alias("languages"),
                      any_issue("CRITICAL").alias("critical"), any_issue("HIGH").alias("high"), of("antipattern", "n").alias("antipatterns"))
    body = F.to_json(F.struct("total_files", "total_lines", "languages", digits(F.col("overall")).alias("overall_confidence"), scoring.risk_level(F.col("overall")).alias("risk_level")))
    advice = recommendations(F.col("overall"), F.col("critical"), F.col("high"), F.col("antipatterns"))
    summary = whole.select(F.inline(F.array(F.struct(F.lit(1).alias("order"), F.lit("summary").alias("name"), body.alias("body")),
                                            F.struct(F.lit(6).alias("order"), F.lit("recommendations").alias("name"), F.to_json(advice).alias("body")))))
    rows = lambda frame, *columns: F.to_json(F.array_sort(F.collect_list(F.struct(*columns))))
    parts = [
        summary,
        _section(scores.agg(rows(scores, "analyzer", digits(F.col("average")).alias("average"), digits(F.col("low")).alias("low"), digits(F.col("high")).alias("high"), "weight").alias("b")), "analyzer_scores", 2, F.col("b")),
        _section(found.where("analyzer = 'antipattern'").groupBy("kind").agg(F.count("*").alias("n")).agg(rows(found, "kind", "n").alias("b")), "antipattern_summary", 3, F.col("b")),
    ]
    shown = ("path", "line_no", "analyzer", "kind", "message", "confidence")
    for order, severity in ((4, "CRITICAL"), (5, "HIGH")):
        first = worst_first(found, severity).agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("by"), *shown))).alias("first"))
        plain = F.to_json(F.transform("first", lambda i: F.struct(*[i[c].alias(c) for c in shown])))
        parts.append(_section(first, f"{severity.lower()}_issues", order, plain))
    return reduce(lambda a, b: a.unionByName(b), parts).select(F.col("name").alias("section"), "order", "body")


def file_reports(files: DataFrame, weights: dict[str, float] = scoring.REPORT_WEIGHTS) -> DataFrame:
    """``(path, language, lines_of_code, confidence, risk)`` of every file: the weighted sum of its detectors."""
    rows = scoring.overall(files, weights, normalise=False).select("path", "confidence")
    known = files.select(F.col("path").alias("_path"), "language", F.size(F.split("content", "\n", -1)).alias("lines_of_code"))
    return rows.join(known, F.col("path") == F.col("_path")).select("path", "language", "lines_of_code", "confidence", scoring.risk_level(F.col("confidence")).alias("risk"))


def executive_summary(scores: DataFrame, threshold: float = 0.4, max_confidence: float = 0.6, max_pct: float = 30.0) -> DataFrame:
    """One row: risk, quality gate with its failures, totals, the share of files at high risk, and the number of remediations."""
    summary = scoring.scan_summary(scores, threshold)
    gates = scoring.quality_gates(summary, max_confidence, max_pct, keep=True)
    return gates.select("risk", F.when(F.col("passed"), F.lit("PASSED")).otherwise(F.lit("FAILED")).alias("quality_gate"), "failures", "files", "reported", "generated",
                        "generated_pct", "confidence", "level", "patterns", "per_file", "high_risk_files", F.col("reported").alias("recommendations"))
