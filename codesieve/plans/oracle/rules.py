"""SQL for rule families, comment predicates and first-match selection."""

from __future__ import annotations

from codesieve.functions.rules import Family
from codesieve.operators.lines import COMMENT_PREFIXES
from codesieve.plans.oracle.sources import arr, lstrip, q, strip


def pattern(rule_pattern: str, flags: str = "") -> str:
    inline = f"(?{flags})" if flags else ""
    return q(inline + rule_pattern)


def has(text: str, rule_pattern: str, flags: str = "") -> str:
    return f"regexp_matches({text}, {pattern(rule_pattern, flags)})"


def count(text: str, rule_pattern: str, flags: str = "") -> str:
    return f"len(regexp_extract_all({text}, {pattern(rule_pattern, flags)}))"


def prefixed(text: str, prefixes) -> str:
    return "(" + " OR ".join(f"starts_with({text}, {q(p)})" for p in prefixes) + ")"


def comment(variant: str, line: str = "line", language: str = "language") -> str:
    groups, default = COMMENT_PREFIXES[variant]
    whens = " ".join(f"WHEN {language} IN ({', '.join(map(q, langs))}) THEN {prefixed(lstrip(line), prefixes)}"
                     for langs, prefixes in groups)
    return f"(CASE {whens} ELSE {prefixed(lstrip(line), default) if default else 'false'} END)"


def first_match(family: Family, text: str = "line", guard=None, overrides=None) -> str:
    overrides = overrides or {}
    whens = []
    for index, rule in enumerate(family.rules, 1):
        test = has(text, overrides.get(rule.name, rule.pattern), family.flags)
        if guard:
            test += f" AND {guard(rule)}"
        whens.append(f"WHEN {test} THEN {index}")
    return f"CASE {' '.join(whens)} END"


def names(family: Family, index: str = "i") -> str:
    return f"{arr([r.name for r in family.rules])}[{index}]"


def confidences(family: Family, index: str = "i") -> str:
    return f"{arr([r.confidence for r in family.rules])}[{index}]::DOUBLE"


def severities(family: Family, index: str = "i") -> str:
    return f"{arr([r.severity for r in family.rules])}[{index}]"


def mapped(key: str, table: dict, default: str | None = None) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v) if isinstance(v, str) else v}" for k, v in table.items())
    tail = f" ELSE {q(default)}" if default is not None else ""
    return f"CASE {key} {whens}{tail} END"


def context(line: str = "line", width: int = 100) -> str:
    return f"left({strip(line)}, {width})"


__all__ = ["arr", "comment", "confidences", "context", "count", "first_match", "has", "mapped", "names",
           "pattern", "prefixed", "q", "severities", "strip", "lstrip"]
