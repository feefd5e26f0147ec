"""Stub, placeholder and marker rules over whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions.rules import Family, Rule
from codesieve.functions.text import strip
from codesieve.operators.detect import TextRule, run_text_rules
from codesieve.rulebook import stubs as S

WEIGHTS = {"CRITICAL": 1.0, "HIGH": 0.8, "MEDIUM": 0.5, "LOW": 0.3}


def pattern_type(family: Family, rule: Rule) -> str:
    return rule.name if family is S.MOCK_NAME else f"{family.name}_{rule.name}"


def description(family: Family, rule: Rule) -> str:
    return family.facts["label"].format(raw=rule.name, spaced=rule.name.replace("_", " "))


def text_rules(families=S.FAMILIES) -> list[TextRule]:
    return [
        TextRule(rule.pattern, family.flags, F.struct(
            F.lit(pattern_type(family, rule)).alias("pattern_type"),
            F.lit(rule.severity).alias("severity"), F.lit(rule.confidence).alias("confidence"),
            F.lit(description(family, rule)).alias("description"),
            F.lit(family.facts["suggestion"]).alias("suggestion")))
        for family in families for rule in family]


def reads_like_a_test(content: Column) -> Column:
    """Function-name findings are dropped when the text opens with "test"."""
    return F.contains(F.left(F.lower(content), F.lit(100)), F.lit("test"))


def findings(files: DataFrame, families=S.FAMILIES, *keep: str) -> DataFrame:
    """One row per match: type, line, severity, confidence, description."""
    live = files.where(F.length(strip(F.col("content"))) > 0) \
        .withColumn("_test", reads_like_a_test(F.col("content")))
    rows = run_text_rules(live, text_rules(families), "path", "language", "_test", *keep)
    return rows.where(~(F.col("_test") & (F.col("pattern_type") == S.MOCK_NAME.rules[0].name))) \
        .drop("_test", "marked_line")


def report(files: DataFrame, families=S.FAMILIES) -> DataFrame:
    return findings(files, families).select("path", "line_no", "pattern_type", "severity", "confidence",
                                            "description", "suggestion")
