"""Rule families: ordered literal patterns turned into column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from codesieve.functions.text import found, text_array


@dataclass(frozen=True)
class Rule:
    name: str
    confidence: float
    pattern: str
    severity: str | None = None


@dataclass(frozen=True)
class Family:
    """An ordered list of rules sharing flags; order decides the first match."""

    name: str
    rules: tuple[Rule, ...]
    flags: str = "i"
    facts: dict = field(default_factory=dict)

    def __iter__(self):
        return iter(self.rules)

    def first_match(self, line: Column, guard: Callable[[Rule], Column] | None = None,
                    low: Column | None = None, held: dict[str, Column] | None = None) -> Column:
        """1-based index of the first rule that matches the line, else null."""
        expr = None
        for index, rule in enumerate(self.rules, 1):
            test = found(line, rule.pattern, self.flags, low, held)
            if guard is not None:
                test = test & guard(rule)
            expr = F.when(test, F.lit(index)) if expr is None else expr.when(test, F.lit(index))
        return expr

    def names(self, index: Column) -> Column:
        return F.element_at(text_array(r.name for r in self.rules), index)

    def confidences(self, index: Column) -> Column:
        return F.element_at(text_array(str(r.confidence) for r in self.rules).cast("array<double>"), index)

    def severities(self, index: Column) -> Column:
        return F.element_at(text_array(str(r.severity) for r in self.rules), index)


def family(name: str, table: str, flags: str = "i", with_severity: bool = False, **facts) -> Family:
    """Parse a text table: ``name confidence [severity] pattern`` per line."""
    rules = []
    for row in table.strip("\n").splitlines():
        if not row.strip():
            continue
        parts = row.split(None, 3 if with_severity else 2)
        severity = parts[2] if with_severity else None
        rules.append(Rule(parts[0], float(parts[1]), parts[-1], severity))
    return Family(name, tuple(rules), flags, facts)
