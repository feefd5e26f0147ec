"""Running rule families over files in one pass.

Line rules: lines are exploded once, every family contributes one index column
(first matching rule), and one generator turns the hits into rows.
Text rules: each match start is marked in the text, and the marked text is
split into lines, which yields the line of every match without offsets.
"""

from __future__ import annotations

from typing import Callable, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions.frames import settled
from codesieve.functions.rules import Family
from codesieve.functions.text import MARK, any_of, escaped, folded, likely, replaced


#: Families whose tests are computed in one step.
TOGETHER = 2
#: Rules of one family whose tests are computed in one step.
AT_ONCE = 12


class LineRule(NamedTuple):
    """``index`` finds the rule per line; ``finding`` builds the struct from it; ``only`` is asked where a rule was found.

    An index in several parts is the first of them that is not null.
    """

    name: str
    index: Column | tuple[Column, ...]
    finding: Callable[[Column], Column]
    only: Column | None = None

    def hit(self) -> Column:
        found_ = F.col(f"_i_{self.name}").isNotNull()
        return found_ if self.only is None else found_ & self.only


def first_rule(rows: DataFrame, family: Family, text: str = "line", low: str = "low", name: str = "i") -> DataFrame:
    """Rows in which a rule of the family matches, with the first one's index; a few rules to a step, as in ``run_line_rules``."""
    parts = [Family(family.name, family.rules[first:first + AT_ONCE], family.flags) for first in range(0, len(family.rules), AT_ONCE)]
    index = lambda k: parts[k].first_match(F.col(text), low=F.col(low)) + k * AT_ONCE
    rows = settled(rows.withColumn(name, index(0)))
    for k in range(1, len(parts)):
        rows = settled(rows.withColumn(name, F.coalesce(F.col(name), index(k))))
    return rows.where(F.col(name).isNotNull())


def run_line_rules(lines: DataFrame, rules: list[LineRule], *keep: str) -> DataFrame:
    """One row per hit: ``keep`` columns plus the finding struct's fields."""
    # The rules of a few families make a method that the JVM still compiles; it interprets larger ones.
    indexed, begun = lines, set()
    parts = [(f"_i_{rule.name}", part) for rule in rules for part in (rule.index if isinstance(rule.index, tuple) else (rule.index,))]
    for first in range(0, len(parts), TOGETHER):
        step: dict[str, Column] = {}
        for name, part in parts[first:first + TOGETHER]:
            before = step[name] if name in step else F.col(name) if name in begun else None
            step[name] = part if before is None else F.coalesce(before, part)
        indexed = settled(indexed.withColumns(step))
        begun |= set(step)
    indexed = indexed.where(any_of(rule.hit() for rule in rules))
    found_rows = [F.when(rule.hit(), rule.finding(F.col(f"_i_{rule.name}")))
                  for rule in rules]
    if len(rules) == 1:
        name = f"_i_{rules[0].name}"
        return indexed.select(*keep, rules[0].finding(F.col(name)).alias("f")) \
            .select(*keep, "f.*")
    return indexed.select(*keep, F.inline(F.array_compact(F.array(*found_rows))))


class TextRule(NamedTuple):
    pattern: str
    flags: str
    facts: Column  # struct of the finding's fields


def run_text_rules(files: DataFrame, rules: list[TextRule], *keep: str) -> DataFrame:
    """One row per match of every rule, with the line the match starts on."""
    content, low = F.col("content"), F.col("_low")
    files = settled(files.select(*keep, escaped(content).alias("content"), folded(content).alias("_low")))
    marked = F.array_compact(F.array(*[
        F.when(likely(content, rule.pattern, rule.flags, low),
               F.struct(rule.facts.alias("facts"), F.lit(order).alias("rule_no"),
                        replaced(content, rule.pattern, MARK + "$0", rule.flags).alias("text")))
        for order, rule in enumerate(rules)]))
    per_rule = files.select(*keep, F.explode(marked).alias("m"))
    per_line = per_rule.select(*keep, "m.facts", "m.rule_no", F.inline(marked_lines(F.col("m.text"))))
    starts = F.length("marked_line") - F.length(F.translate("marked_line", MARK, ""))
    return per_line.select(*keep, "line_no", "rule_no", "facts.*",
                           F.explode(F.sequence(F.lit(1), starts)).alias("nth"), "marked_line")


def marked_lines(text: Column) -> Column:
    """Numbered lines holding a mark; all others are dropped before any row is made."""
    numbered = F.transform(F.split(text, "\n", -1), lambda line, i: F.when(F.contains(line, F.lit(MARK)), F.struct(
        (i + 1).alias("line_no"), line.alias("marked_line"))))
    return F.filter(numbered, lambda s: s.isNotNull())


def first_match_rule(family: Family, line: Column, build: Callable[[Column], Column],
                     where: Column | None = None, guard=None) -> LineRule:
    index = family.first_match(line, guard)
    return LineRule(family.name, F.when(where, index) if where is not None else index, build)
