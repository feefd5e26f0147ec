"""Findings algebra: counts, ranks, per-detector confidence, scan totals, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesieve.functions.frames import settled
from codesieve.functions.text import lookup
from codesieve.operators import (antipatterns, architecture, emoji, metrics, naming, security, stubs, wording)
from codesieve.sources.tables import kept

RANK = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}

# Severity weights (C/H/M/L), caps and phase weights.
#: A file's first repeats that count as evidence; further ones would drown the other signals.
DUPLICATES_COUNTED = 5
WEIGHTS = {
    "pattern": (0.35, 0.25, 0.15, 0.10), "statistical": (1.2, 0.9, 0.6, 0.3), "security": (1.5, 1.0, 0.6, 0.3),
    "semantic": (1.2, 0.9, 0.6, 0.3), "architectural": (1.2, 0.9, 0.6, 0.3), "comment": (0.40, 0.30, 0.18, 0.08),
    "antipattern": (1.0, 0.75, 0.5, 0.25), "mock": (1.0, 0.8, 0.5, 0.3),
}
PHASE_WEIGHTS = {"pattern": 0.25, "statistical": 0.20, "security": 0.20, "emoji": 0.15, "semantic": 0.10,
                 "architectural": 0.05, "mock": 0.05}
REPORT_WEIGHTS = {"pattern": 0.22, "statistical": 0.18, "security": 0.16, "mock": 0.15, "emoji": 0.10,
                  "architectural": 0.03, "comment": 0.04, "antipattern": 0.12}


def severity_rank(severity: Column) -> Column:
    return lookup(severity, RANK, 4)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _pick(rows: DataFrame, kind: str, severity: str | None = None, confidence: float | None = None) -> DataFrame:
    return rows.select("path", F.lit(kind).alias("kind"), F.lit(severity).alias("severity") if severity else F.col("severity"),
                       F.lit(confidence).alias("confidence") if confidence is not None else F.col("confidence"))


def _halstead_evidence(scores: DataFrame) -> DataFrame:
    """High volume, difficulty and predicted bugs, from one count of the operators (``metrics.maintainability_scores``)."""
    volume, difficulty, bugs = F.col("volume"), F.col("difficulty"), F.col("bugs")
    item = lambda test, kind, severity, value: F.when(test, F.struct(F.lit(kind).alias("kind"), severity.alias("severity"), value.alias("confidence")))
    return settled(scores).select("path", F.inline(F.array_compact(F.array(
        item(volume > 1000, "high_halstead_volume", F.lit("HIGH"), F.least(F.lit(0.85), volume / 2000)),
        item(difficulty > 30, "high_halstead_difficulty", F.lit("HIGH"), F.least(F.lit(0.85), difficulty / 60)),
        item(bugs > 1.0, "high_bug_prediction", F.when(bugs > 2.0, F.lit("HIGH")).otherwise(F.lit("MEDIUM")), F.least(F.lit(0.80), bugs / 3.0))))))


def _shared(files: DataFrame, analyzer: str) -> tuple[DataFrame, ...]:
    """What a detector reads both for its evidence and for its score: found once."""
    if analyzer == "pattern":
        return kept(metrics.ngram_scores(files), "grams"), kept(metrics.token_entropies(files), "entropies")
    if analyzer == "architectural":
        return (kept(architecture.python_classes(files), "classes"),)
    if analyzer == "comment":
        return (kept(wording.comments(files), "comments"),)
    return ()


def evidence(files: DataFrame, analyzer: str, shared: tuple[DataFrame, ...] | None = None) -> DataFrame:
    """``(path, kind, severity, confidence)`` of one detector. ``shared``: ``_shared``, if at hand."""
    shared = _shared(files, analyzer) if shared is None else shared
    if analyzer == "security":
        return security.findings(files).select("path", F.col("finding_type").alias("kind"), "severity", "confidence")
    if analyzer == "mock":
        return stubs.findings(files).select("path", F.col("pattern_type").alias("kind"), "severity", "confidence")
    if analyzer == "antipattern":
        return antipatterns.all_findings(files).select("path", F.col("antipattern").alias("kind"), "severity", "confidence")
    if analyzer == "architectural":
        return architecture.all_findings(files, *shared).select("path", "kind", "severity", "confidence")
    if analyzer == "semantic":
        formal = wording.formality(files).where("high").select(
            "path", F.lit("high_formality").alias("kind"), F.lit("MEDIUM").alias("severity"), F.col("score").alias("confidence"))
        return _union([wording.comment_quality(files).select("path", "kind", "severity", "confidence"),
                       _pick(wording.writing_style(files), "ai_writing_style"), _pick(wording.naming_styles(files), "inconsistent_naming"),
                       _pick(wording.docstring_shapes(files), "perfect_docstring"),
                       _pick(wording.vocabulary(files).where("severity is not null"), "ai_vocabulary"), formal])
    if analyzer == "comment":
        every, = shared
        return _union([_pick(wording.comment_phrases(files, every), "verbose_phrase"),
                       wording.obvious_comments(files, every).select("path", "kind", "severity", "confidence"),
                       wording.comment_ratio(files, every).select("path", "kind", "severity", "confidence"),
                       wording.comment_length(files, every=every).select("path", "kind", "severity", "confidence"),
                       _pick(wording.filler_words(files, every), "filler_words"), _pick(wording.redundant_comments(files, every), "redundant_comment")])
    if analyzer == "pattern":
        flagged = lambda rows, kind: _pick(rows.where("severity is not null"), kind)
        grams, entropies = shared
        uses = kept(naming.code_identifiers(files), "names")
        return _union([_pick(naming.generic_names(files, uses), "generic_naming"), _pick(naming.name_overuse(files, uses), "generic_name_overuse"),
                       _pick(naming.verbose_comments(files), "verbose_comments"), _pick(naming.comment_share(files), "verbose_comments"),
                       _pick(naming.boolean_traps(files), "boolean_trap"), _pick(naming.magic_numbers(files), "magic_numbers"),
                       _pick(naming.god_functions(files), "god_function"),
                       flagged(metrics.ngram_repetition(files, grams), "ngram_repetition"), flagged(metrics.token_entropy(files, entropies), "low_token_entropy")])
    if analyzer == "statistical":
        flagged = lambda rows, kind: _pick(rows.where("severity is not null"), kind)
        # Three rules read the sections and two the statistics.
        sections, scores = kept(metrics.cognitive_segments(files, complexity=True), "sections"), kept(metrics.maintainability_scores(files), "statistics")
        return _union([
            _pick(metrics.cyclomatic_lines(files, sections), "cyclomatic_complexity"), flagged(metrics.cognitive(files, sections), "cognitive_complexity"),
            _pick(metrics.cognitive_hotspots(files, sections), "complexity_hotspot", "HIGH", 0.75),
            _halstead_evidence(scores),
            flagged(metrics.token_diversity(files), "token_diversity"), _pick(metrics.nesting_depth(files), "nesting_depth"),
            _pick(metrics.duplicate_blocks(files, DUPLICATES_COUNTED), "code_duplication"), _pick(metrics.function_parameters(files), "excessive_parameters"),
            flagged(metrics.maintainability(files, scores), "low_maintainability")])
    raise ValueError(f"unknown analyzer {analyzer!r}")


#: Sums are taken in whole billionths, so that they don't depend on the order in which rows arrive.
UNITS = 1e9


def _units(value: Column) -> Column:
    return F.round(value * UNITS).cast("long")


def _totals(files: DataFrame, rows: DataFrame, analyzer: str) -> DataFrame:
    """Per file, findings or not: lines, weighted evidence, count (one exchange)."""
    weight = lookup(F.col("severity"), dict(zip(RANK, WEIGHTS[analyzer])))
    zero = files.select("path", F.size(F.split("content", "\n", -1)).alias("total_lines"), F.lit(0).cast("long").alias("w"), F.lit(0).alias("n"))
    hits = rows.select("path", F.lit(0).alias("total_lines"), _units(weight * F.col("confidence")).alias("w"), F.lit(1).alias("n"))
    return zero.unionByName(hits).groupBy("path").agg(
        F.max("total_lines").alias("total_lines"), (F.sum("w") / UNITS).alias("w"), F.sum("n").alias("n"))


def confidence(files: DataFrame, analyzer: str) -> DataFrame:
    """``(path, score, n)`` of one detector, with its own normalisation and cap; n findings."""
    w, n, lines_ = F.col("w"), F.col("n"), F.col("total_lines")
    if analyzer == "emoji":
        known = emoji.metrics(files).select("path", F.col("confidence").alias("c"), F.col("emojis").alias("n"))
        zero = files.select("path", F.lit(0.0).alias("c"), F.lit(0).cast("long").alias("n"))
        return zero.unionByName(known).groupBy("path").agg(F.max("c").alias("score"), F.max("n").alias("n"))
    shared = _shared(files, analyzer)
    t = _totals(files, evidence(files, analyzer, shared), analyzer)
    per = lambda size, cap: F.least(F.lit(cap), w / F.greatest(F.lit(1.0), lines_ / size))
    if analyzer == "pattern":
        grams, entropies = shared
        t = t.join(grams.select("path", F.col("score").alias("r")), "path").join(entropies, "path")
        extra = F.when(F.col("r") > 0.3, (F.col("r") - 0.3) * 0.3).otherwise(0.0) \
            + F.when(F.col("entropy") < 4.0, (4.0 - F.col("entropy")) / 4.0 * 0.2).otherwise(0.0)
        full = F.least(F.lit(0.95), F.least(F.lit(0.90), w + extra) + F.least(F.lit(0.40), n * 0.12))
        scaled = F.when(lines_ < 5, full * 0.85).otherwise(full)
        quiet = F.when((F.col("r") < 0.3) & (F.col("entropy") > 4.0), F.lit(0.0)).otherwise(F.lit(0.05))
        score = F.when(n == 0, quiet).otherwise(scaled)
    elif analyzer == "architectural":
        count = shared[0].groupBy("path").agg(F.count("*").alias("classes"))
        script = files.where("language in ('javascript', 'typescript')").select(
            "path", F.regexp_count("content", F.lit(r"(?m)^class\s+\w+")).cast("long").alias("classes"))
        t = t.join(count.unionByName(script), "path", "left")
        score = F.least(F.lit(0.88), w / F.greatest(F.lit(1.0), lines_ / 100 + F.coalesce("classes", F.lit(0))))
    elif analyzer == "comment":
        t = t.join(shared[0].groupBy("path").agg(F.count("*").alias("comments")), "path", "left")
        density = F.least(F.lit(1.0), n / F.greatest(F.lit(1), F.coalesce("comments", F.lit(0))) * 2)
        score = F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.lit(0.95), w * density + n * 0.05))
    elif analyzer == "mock":
        score = F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.try_divide(w, n) * 0.6 + F.least(F.lit(1.0), n / 10) * 0.25 + F.least(
            F.lit(1.0), n / F.greatest(lines_, F.lit(1)) * 100 / 5) * 0.15))
    else:
        size, cap = {"statistical": (25, 0.92), "security": (15, 0.95), "semantic": (20, 0.88), "antipattern": (100, 0.92)}[analyzer]
        score = per(size, cap)
    return t.select("path", score.alias("score"), F.col("n").cast("long").alias("n"))


def phase_scores(files: DataFrame, analyzers) -> DataFrame:
    return _union([confidence(files, a).select("path", F.lit(a).alias("analyzer"), "score", "n") for a in analyzers])


def overall(files: DataFrame, weights: dict[str, float] = PHASE_WEIGHTS, normalise: bool = True) -> DataFrame:
    """Weighted mean of the phases (or their weighted sum) with its level."""
    w = lookup(F.col("analyzer"), weights)
    total = F.sum(_units(F.col("score") * w)) / UNITS
    value = F.least(F.lit(1.0), total / sum(weights.values())) if normalise else total
    return phase_scores(files, weights).groupBy("path").agg(value.alias("confidence"), F.sum("n").alias("patterns")) \
        .withColumn("level", confidence_level(F.col("confidence")))


def confidence_level(score: Column) -> Column:
    return F.when(score < 0.2, F.lit("none")).when(score < 0.4, F.lit("low")).when(score < 0.6, F.lit("medium")) \
        .when(score < 0.8, F.lit("high")).otherwise(F.lit("very_high"))


def risk_level(score: Column) -> Column:
    """Risk scale of detectors and reports."""
    return F.when(score >= 0.75, F.lit("CRITICAL")).when(score >= 0.55, F.lit("HIGH")).when(score >= 0.35, F.lit("MEDIUM")) \
        .when(score >= 0.15, F.lit("LOW")).otherwise(F.lit("MINIMAL"))


def security_risk(score: Column) -> Column:
    return F.when(score >= 0.7, F.lit("CRITICAL")).when(score >= 0.5, F.lit("HIGH")).when(score >= 0.3, F.lit("MEDIUM")).otherwise(F.lit("LOW"))


def project_risk(score: Column) -> Column:
    return F.when(score < 0.3, F.lit("low")).when(score < 0.5, F.lit("medium")).when(score < 0.7, F.lit("high")).otherwise(F.lit("critical"))


# --- counts and ranks -------------------------------------------------------------
def count_by(findings: DataFrame, *columns: str) -> DataFrame:
    return findings.groupBy(*columns).agg(F.count("*").alias("n"))


def grouping_counts(findings: DataFrame) -> DataFrame:
    """Counts by type, by severity and by category in one pass (grouping sets)."""
    view = findings.groupingSets([[F.col("finding_type")], [F.col("severity")], [F.col("cwe")]],
                                 F.col("finding_type"), F.col("severity"), F.col("cwe"))
    return view.agg(F.count("*").alias("n"))


def severity_summary(findings: DataFrame) -> DataFrame:
    """Zero-filled severity counts per file and first word of the type."""
    counts = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in RANK]
    return findings.groupBy("path", F.substring_index("pattern_type", "_", 1).alias("category")).agg(F.count("*").alias("total"), *counts)


def top_per_file(findings: DataFrame, k: int = 5) -> DataFrame:
    order = Window.partitionBy("path").orderBy(severity_rank(F.col("severity")), F.desc("confidence"), "line_no", "finding_type")
    return findings.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_issues(findings: DataFrame, k: int = 20) -> DataFrame:
    """Global top-k: a partial top-k per partition, then k rows to rank."""
    return findings.orderBy(severity_rank(F.col("severity")), F.desc("confidence"), "path", "line_no", "finding_type").limit(k)


# --- scan totals and gates -----------------------------------------------------------
def scan_summary(scores: DataFrame, threshold: float) -> DataFrame:
    """One row of totals over the scores of ``overall``; the mean is taken over files at or above the threshold.

    The findings of all detectors came with the scores, so nothing is read again.
    """
    reported = F.col("confidence") >= threshold
    hot = F.col("confidence") >= 0.4
    totals = scores.agg(
        F.count("*").alias("files"), F.count_if(reported).alias("reported"), F.count_if(reported & hot).alias("generated"),
        F.count_if(reported & (F.col("confidence") >= 0.6)).alias("critical_files"), F.coalesce(F.sum("patterns"), F.lit(0)).alias("patterns"),
        F.coalesce(F.try_divide(F.sum(F.when(reported, _units(F.col("confidence")))), F.count_if(reported) * UNITS), F.lit(0.0)).alias("mean"),
        F.count_if(F.col("level").isin("high", "very_high")).alias("high_risk_files"))
    return totals.select(
        "files", "reported", "generated", "critical_files", "patterns",
        F.round(F.col("generated") / F.greatest(F.col("files"), F.lit(1)) * 100, 6).alias("generated_pct"), F.round("mean", 6).alias("confidence"),
        confidence_level(F.col("mean")).alias("level"), F.round(F.col("patterns") / F.greatest(F.col("files"), F.lit(1)), 6).alias("per_file"), "high_risk_files")


def quality_gates(summary: DataFrame, max_confidence: float = 0.6, max_pct: float = 30.0, keep: bool = False) -> DataFrame:
    """Gates that fail, whether all passed, and the risk; with ``keep``, the summary's columns as well."""
    failures = F.array_compact(F.array(
        F.when(F.col("confidence") > max_confidence, F.lit("confidence")),
        F.when(F.col("generated_pct") > max_pct, F.lit("share")),
        F.when(F.col("critical_files") > 0, F.lit("critical files"))))
    return summary.select(F.array_join(failures, ",").alias("failures"), (F.size(failures) == 0).alias("passed"),
                          project_risk(F.col("confidence")).alias("risk"), *(summary.columns if keep else ()))


def remediation(scores: DataFrame, threshold: float = 0.4) -> DataFrame:
    level = F.col("level")
    priority = F.when(level == "very_high", F.lit("CRITICAL")).when(level == "high", F.lit("HIGH")) \
        .when(level == "medium", F.lit("MEDIUM")).otherwise(F.lit("LOW"))
    actions = F.when(level == "very_high", F.lit(
        "Have a second person read it line by line|Rewrite the parts nobody can explain|Write down which tools produced it|Cover it with tests")) \
        .when(level == "high", F.lit(
            "Have a second person read it|Explain the logic in comments|Try the error paths|Look for security holes")) \
        .otherwise(F.lit("Read it when there is time|Write down which tools helped"))
    return scores.where(F.col("confidence") >= threshold).select("path", priority.alias("priority"), actions.alias("actions"))
