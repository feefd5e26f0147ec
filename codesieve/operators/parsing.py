"""Line-pattern parser: functions, classes, imports, complexity, line kinds."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions.text import capture, found, hits, occurrences, strip
from codesieve.operators.lines import lines
from codesieve.rulebook import grammar as G


def _by_language(key: str, use, default=None) -> Column:
    """Apply ``use(pattern)`` per language; unknown languages read as Python."""
    language = F.col("language")
    groups: dict[str, list[str]] = {}
    for name, table in G.LINE_PATTERNS.items():
        if key in table and name != "python":
            groups.setdefault(table[key], []).append(name)
    missing = [name for name, table in G.LINE_PATTERNS.items() if key not in table]
    expr = F.when(language.isin(missing or ["-"]), F.lit(default)) if default is not None or missing else None
    for pattern, names in groups.items():
        cond = language.isin(names)
        expr = F.when(cond, use(pattern)) if expr is None else expr.when(cond, use(pattern))
    return expr.otherwise(use(G.LINE_PATTERNS["python"][key]))


def _first_group(line: Column):
    """First non-empty capture group, as one regex evaluation per group."""
    def use(pattern: str) -> Column:
        parts = [F.nullif(capture(line, pattern, g), F.lit("")) for g in range(1, re.compile(pattern).groups + 1)]
        return F.coalesce(*parts, F.lit("")) if len(parts) > 1 else F.coalesce(parts[0], F.lit(""))
    return use


def functions(files: DataFrame) -> DataFrame:
    line = F.col("line")
    rows = lines(files).where(_by_language("f", lambda p: found(line, p), False))
    return rows.select("path", "line_no", _by_language("f", _first_group(line), "").alias("name"),
                       F.contains(F.lower(line), F.lit("async")).alias("is_async"))


def classes(files: DataFrame) -> DataFrame:
    line = F.col("line")
    rows = lines(files).where(_by_language("c", lambda p: found(line, p), False))
    return rows.select("path", "line_no", _by_language("c", lambda p: capture(line, p), "").alias("name"))


def imports(files: DataFrame) -> DataFrame:
    line = F.col("line")
    rows = lines(files).where(_by_language("i", lambda p: found(line, p), False))
    return rows.select("path", "line_no", _by_language("i", _first_group(line), "").alias("module"))


def keyword_complexity(files: DataFrame) -> DataFrame:
    """One plus the decision words (whole words) and decision signs."""
    content, language = F.col("content"), F.col("language")

    def total(keys: list[str]) -> Column:
        word_keys = [k for k in keys if k.isalpha()]
        signs = [k for k in keys if not k.isalpha()]
        # Keywords never overlap as whole words, so one alternation counts them all.
        out = hits(content, r"\b(?:" + "|".join(word_keys) + r")\b") + 1
        return reduce(lambda acc, sign: acc + occurrences(content, sign), signs, out)

    groups: dict[tuple, list[str]] = {}
    for name, keys in G.COMPLEXITY_KEYWORDS.items():
        if name != "python":
            groups.setdefault(tuple(keys), []).append(name)
    expr = None
    for keys, names in groups.items():
        cond = language.isin(names)
        expr = F.when(cond, total(list(keys))) if expr is None else expr.when(cond, total(list(keys)))
    return files.select("path", expr.otherwise(total(G.COMPLEXITY_KEYWORDS["python"])).alias("complexity"))


def line_kinds(files: DataFrame) -> DataFrame:
    """Code, comment and blank lines, with docstring state for Python.

    A triple-quoted block opens on a line holding exactly one delimiter and
    closes on the next line holding it; block comments elsewhere.
    """
    python = F.col("language") == "python"
    text = F.transform(F.split("content", "\n", -1), strip)

    def step(state: Column, line: Column) -> Column:
        """state: open delimiter (0 none, 1 double, 2 single, 3 block) and counters."""
        opened = state["open"]
        blank = F.length(line) == 0
        double, single = occurrences(line, '"""'), occurrences(line, "'''")
        closes = F.when(opened == 1, double > 0).when(opened == 2, single > 0).otherwise(F.contains(line, F.lit("*/")))
        starts_quote = python & ((double > 0) | (single > 0))
        # A block comment that also closes after its opening sign stays on its line.
        after = F.substring(line, F.instr(line, "/*") + 2, F.length(line))
        starts_block = ~python & F.contains(line, F.lit("/*"))
        next_open = F.when(blank, opened).when(opened > 0, F.when(closes, F.lit(0)).otherwise(opened)) \
            .when(starts_quote, F.when(double > 0, F.when(double == 1, F.lit(1)).otherwise(F.lit(0)))
                  .otherwise(F.when(single == 1, F.lit(2)).otherwise(F.lit(0)))) \
            .when(starts_block, F.when(F.contains(after, F.lit("*/")), F.lit(0)).otherwise(F.lit(3))).otherwise(F.lit(0))
        comment = ~blank & ((opened > 0) | starts_quote | starts_block
                            | F.when(python, F.startswith(line, F.lit("#"))).otherwise(F.startswith(line, F.lit("//"))))
        return F.struct(next_open.alias("open"), (state["blank"] + blank.cast("int")).alias("blank"),
                        (state["comment"] + comment.cast("int")).alias("comment"))

    zero = F.struct(F.lit(0).alias("open"), F.lit(0).alias("blank"), F.lit(0).alias("comment"))
    known = files.where(F.col("language").isin("python", "javascript", "typescript", "java"))
    rows = known.select("path", F.aggregate(text, zero, step).alias("s"), F.size(text).alias("total"))
    return rows.select("path", "total", F.col("s.blank").alias("blank"), F.col("s.comment").alias("comment"),
                       (F.col("total") - F.col("s.blank") - F.col("s.comment")).alias("code"))


