"""Emoji in code: matches, context, clusters and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions.frames import settled
from codesieve.functions.text import found, hits, lookup, matches, occurrences, replaced, rx, with_running_sums
from codesieve.operators.lines import is_comment, lines
from codesieve.rulebook import emoji as E

EMOJI = E.char_class()
EMOJI_REMOVED = E.char_class(E.REMOVER_RANGES)
CATEGORY = {char: row[1] for char, row in E.WEIGHTED.items()}
WEIGHT = {char: row[0] for char, row in E.WEIGHTED.items()}
SCORE = {char: row[2] for char, row in E.WEIGHTED.items()}


def remove(text: Column) -> Column:
    return replaced(text, EMOJI_REMOVED + "+", "")


def _per_emoji(pieces: Column, flag) -> Column:
    """``flag(piece, index)`` of the pieces of a text, once for each emoji in them, in order."""
    return F.flatten(F.transform(pieces, lambda p, i: F.array_repeat(flag(p, i), F.regexp_count(p, F.lit(rx(EMOJI))))))


def emoji_matches(files: DataFrame) -> DataFrame:
    """One row per emoji: line, column, code point, context (comment, docstring, string or code - in that order), category.

    Contexts are read off pieces of the whole line, so the work is linear in it however many emoji it holds.
    """
    line, python = F.col("line"), F.col("language") == "python"
    # No emoji is an ASCII character: most lines have none other.
    rows = lines(files).where((F.octet_length(line) != F.length(line)) & found(line, EMOJI))
    # Without escapes a literal is a quote up to its like or the end; an escaped emoji stays, to be counted.
    bare = replaced(line, rf"\\(?!{EMOJI})[\s\S]", "")
    literals = matches(bare, r"\"[^\"]*(?:\"|\z)|'[^']*(?:'|\z)|[^\"']+")
    rows = settled(rows.select(
        "path", "line_no", "line", is_comment("emoji", line, F.col("language")).alias("comment"), python.alias("python"),
        F.split(line, rx(EMOJI), -1).alias("gaps"), matches(line, EMOJI).alias("found"),
        literals.alias("literals"), F.split(line, "[\"']", -1).alias("after_quotes")))
    gap_sums = {"spans": F.zip_with("gaps", "found", lambda g, e: F.length(g) + F.coalesce(F.length(e), F.lit(0))),
                "doubles": F.transform("gaps", lambda g: occurrences(g, '"""')),
                "singles": F.transform("gaps", lambda g: occurrences(g, "'''"))}
    rows = settled(rows.select(
        "path", "line_no", "comment", "python", "found", *[c.alias(name) for name, c in gap_sums.items()],
        _per_emoji(F.col("literals"), lambda p, i: F.left(p, F.lit(1)).isin("'", '"')).alias("inside"),
        _per_emoji(F.col("after_quotes"), lambda p, i: (i > 0) & F.endswith(F.get("after_quotes", i - 1), F.lit("f"))).alias("formatted")))
    for name in gap_sums:
        rows = with_running_sums(rows, name, name + "_so_far")
    odd = lambda name, i: F.get(name + "_so_far", i) % 2 == 1
    where = lambda i: F.when(F.col("comment"), F.lit("comment")) \
        .when(F.col("python") & (odd("doubles", i) | odd("singles", i)), F.lit("docstring")) \
        .when(F.get("inside", i) | F.get("formatted", i), F.lit("string")).otherwise(F.lit("code"))
    spots = rows.select("path", "line_no", F.inline(F.transform("found", lambda e, i: F.struct(
        (F.get("spans_so_far", i) - F.length(e)).alias("col_no"), F.left(e, F.lit(1)).alias("emoji"), where(i).alias("context")))))
    code = F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii("emoji")), F.greatest(F.lit(4), F.length(F.hex(F.ascii("emoji")))), F.lit("0")))
    return spots.select("path", "line_no", "col_no", "emoji", code.alias("code_point"), "context",
                        lookup(F.col("emoji"), CATEGORY, "other").alias("category"))


def categories(files: DataFrame) -> DataFrame:
    return emoji_matches(files).groupBy("category").agg(F.count("*").alias("n"))


def clusters(files: DataFrame) -> DataFrame:
    """Lines with three or more emoji."""
    n = hits(F.col("line"), EMOJI)
    return lines(files).select("path", "line_no", n.alias("n")).where("n >= 3")


def indicators(files: DataFrame) -> DataFrame:
    """Per line: count, severity and weight."""
    per_line = emoji_matches(files).groupBy("path", "line_no").agg(
        F.count("*").alias("n"), F.max((F.col("context") == "code").cast("int")).alias("in_code"))
    n = F.col("n")
    severity = F.when(F.col("in_code") == 1, F.lit("CRITICAL")).when(n > 3, F.lit("HIGH")) \
        .when(n > 1, F.lit("MEDIUM")).otherwise(F.lit("LOW"))
    return per_line.select("path", "line_no", "n", severity.alias("severity"),
                           F.least(n * 2.5, F.lit(12.0)).alias("weight"))


def metrics(files: DataFrame) -> DataFrame:
    """Totals, confidence, mean score and severity of files that hold emoji."""
    e = F.col("emoji")
    scored = emoji_matches(files).select(
        "path", "line_no", "context", e.isin(list(E.WEIGHTED)).cast("int").alias("weighted"),
        e.isin(E.HUMAN).cast("int").alias("human"),
        F.coalesce(lookup(e, SCORE), F.when(e.isin(E.HUMAN), F.lit(0.3)).otherwise(F.lit(0.5))).alias("score"))
    per_line = scored.groupBy("path", "line_no").agg(
        F.count("*").alias("n"), F.sum("weighted").alias("weighted"), F.sum("human").alias("human"), F.sum("score").alias("score"),
        *[F.count_if(F.col("context") == c).alias(f"in_{c}") for c in ("comment", "docstring", "string", "code")])
    per_file = per_line.groupBy("path").agg(
        F.sum("n").alias("emojis"), F.count("*").alias("emoji_lines"), F.count_if(F.col("n") >= 3).alias("clusters"),
        *[F.sum(c).alias(c) for c in ("weighted", "human", "score", "in_comment", "in_docstring", "in_string", "in_code")])
    sizes = files.select("path", F.size(F.split("content", "\n", -1)).alias("total_lines"))
    return per_file.join(sizes, "path").select("*", _confidence().alias("confidence"), _severity().alias("severity"))


def _density() -> Column:
    return F.col("emojis") / F.greatest(F.col("total_lines"), F.lit(1))


def _confidence() -> Column:
    c = F.col
    parts = F.least(_density() * 15, F.lit(0.25)) \
        + F.when(c("in_code") > 0, 0.45 + c("in_code") * 0.05).otherwise(0.0) \
        + F.when(c("in_comment") > 0, 0.05 + c("in_comment") * 0.02).otherwise(0.0) \
        + F.when(c("clusters") > 0, 0.15 + c("clusters") * 0.05).otherwise(0.0) \
        + F.least(c("weighted") * 0.03, F.lit(0.15)) - F.least(c("human") * 0.02, F.lit(0.10))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), parts))


def _severity() -> Column:
    return F.when(F.col("in_code") > 0, F.lit("CRITICAL")).when(F.col("clusters") > 0, F.lit("HIGH")) \
        .when((_density() > 0.15) | (F.col("emojis") > 10), F.lit("HIGH")) \
        .when((_density() > 0.08) | (F.col("emojis") > 5), F.lit("MEDIUM")).otherwise(F.lit("LOW"))


def metrics_report(files: DataFrame) -> DataFrame:
    return metrics(files).select(
        "path", "emojis", "emoji_lines", "clusters", "in_comment", "in_docstring", "in_string", "in_code", "total_lines",
        F.round(F.col("score") / F.col("emojis"), 9).alias("mean_score"), F.round("confidence", 9).alias("confidence"), "severity")


