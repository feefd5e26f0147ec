"""Security rule families over code lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions.rules import Family, Rule
from codesieve.functions.text import capture, found, lookup, may_match, replaced, rx, strip
from codesieve.operators.detect import LineRule, run_line_rules
from codesieve.operators.lines import context, is_comment, lines, with_low, with_signs
from codesieve.rulebook import security as S

WEIGHTS = {"CRITICAL": 1.5, "HIGH": 1.0, "MEDIUM": 0.6, "LOW": 0.3}
COLUMNS = ("path", "line_no")
#: Guarded rules of a family whose tests are computed in one step.
GUARDED = 5
QUOTED_VALUE = r"[\"']([^\"']+)[\"']"


def _not_test_value(line: Column):
    """A secret whose quoted value reads like a test value does not count."""
    words = "|".join(S.TEST_VALUE_WORDS)

    def guard(rule: Rule) -> Column:
        matched = F.regexp_extract(line, rx(rule.pattern, "i"), 0)
        return ~found(F.lower(capture(matched, QUOTED_VALUE)), words)

    return guard


def _finding(family: Family, line: Column):
    facts = family.facts

    def build(index: Column) -> Column:
        severity = family.severities(index) if family.rules[0].severity else F.lit(facts["severity"])
        cvss = lookup(severity, facts["cvss_by_severity"]) if "cvss_by_severity" in facts else F.lit(facts["cvss"])
        advice = F.lit(facts["suggestion"])
        if "suggestion_by_rule" in facts:
            advice = lookup(family.names(index), facts["suggestion_by_rule"], facts["suggestion"])
        shown = context(line)
        if family is S.HARDCODED_SECRET:  # the value itself is never shown
            shown = F.concat(F.left(replaced(strip(line), r"[\"'][^\"']*[\"']", "***"), F.lit(50)),
                             F.lit("...[REDACTED]"))
        return F.struct(
            F.lit(family.name).alias("finding_type"), family.names(index).alias("rule"),
            severity.alias("severity"), family.confidences(index).alias("confidence"),
            F.lit(facts["cwe"]).alias("cwe"), F.lit(facts["owasp"]).alias("owasp"),
            cvss.cast("double").alias("cvss"), shown.alias("context"), advice.alias("suggestion"))

    return build


def line_rules(families=S.FAMILIES, held: dict[str, Column] | None = None) -> list[LineRule]:
    line, language = F.col("line"), F.col("language")
    rules = []
    for family in families:
        where = None
        only = None
        guard = None
        if family.facts.get("languages"):
            where = language.isin(list(family.facts["languages"]))
        if family is S.INSECURE_RANDOM:
            only = found(line, "|".join(S.RANDOM_CONTEXT_WORDS), "i")
        if family is S.HARDCODED_SECRET:
            guard = _not_test_value(line)
        # Guarded rules make long code: they are asked in parts.
        size = len(family.rules) if guard is None else GUARDED
        parts = [Family(family.name, family.rules[first:first + size], family.flags).first_match(line, guard, F.col("low"), held) + first
                 for first in range(0, len(family.rules), size)]
        rules.append(LineRule(family.name, tuple(F.when(where, part) if where is not None else part for part in parts),
                              _finding(family, line), only))
    return rules


def findings(files: DataFrame, families=S.FAMILIES) -> DataFrame:
    """Security findings: one row per line and family, first matching rule wins."""
    code = with_low(lines(files).where(~is_comment("security", F.col("line"), F.col("language"))))
    worth = may_match(F.col("line"), F.col("low"), [(rule.pattern, family.flags) for family in families for rule in family])
    code, held = with_signs(code.where(worth))
    return run_line_rules(code, line_rules(families, held), *COLUMNS)
