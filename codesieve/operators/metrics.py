"""Per-file statistics: tokens, complexity, nesting, duplication, maintainability.

Set sizes come from arrays inside the file's row, so most metrics need no
shuffle.  Frequencies (entropy, most repeated n-grams) are counted in sorted
arrays after the texts of a path have met once; no row is made per token.
"""

from __future__ import annotations

from functools import reduce
from itertools import islice
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesieve.functions.blocks import WINDOW_LINES, each_repeat
from codesieve.functions.frames import settled
from codesieve.functions.tokens import count_grams, count_identifiers, count_operators
from codesieve.functions.text import (capture, found, hits, indent, lstrip, matches, occurrences, replaced, starts_with_any,
                                      strip, strip_each)
from codesieve.operators.lines import is_comment, lines
from codesieve.operators.naming import identifiers
from codesieve.operators.segments import segments
from codesieve.rulebook import grammar as G
from codesieve.rulebook import style as R


def words(text: Column) -> Column:
    return matches(text, r"\b\w+\b")


def _grams(tokens: Column, n: int) -> Column:
    size = F.size(tokens)
    tail = lambda k: F.slice(tokens, F.lit(k + 1), F.greatest(size - (n - 1), F.lit(0)))
    return reduce(lambda left, k: F.zip_with(left, tail(k), lambda a, b: F.concat(a, F.lit(" "), b)),
                  range(1, n), tail(0))


def ngram_scores(files: DataFrame) -> DataFrame:
    """Repetition of word pairs and triples, weighted 0.4 and 0.6; short texts score 0."""
    rows = settled(files.select("path", words(F.lower("content")).alias("t")))
    # Settled, so that a filter on the score doesn't count again for each use of a count.
    rows = settled(rows.select("path", F.size("t").alias("tokens"), count_grams("t").alias("u")).select("path", "tokens", "u.u2", "u.u3"))
    n = F.col("tokens")
    score = F.when(n < 20, F.lit(0.0)).otherwise((1 - F.col("u2") / (n - 1)) * 0.4 + (1 - F.col("u3") / (n - 2)) * 0.6)
    return rows.select("path", "tokens", "u2", "u3", score.alias("score"))


def ngram_repetition(files: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Repetition with its severity. ``scores``: ``ngram_scores``, if at hand."""
    score = F.col("score")
    return (ngram_scores(files) if scores is None else scores).select(
        "path", "tokens", "u2", "u3", F.round(score, 9).alias("score"),
        F.when(score > 0.5, F.lit("CRITICAL")).when(score > 0.3, F.lit("HIGH")).alias("severity"),
        F.when(score > 0.3, F.round(F.least(F.lit(0.90), score + 0.4), 9)).alias("confidence"))


def repeated_triples(files: DataFrame, k: int = 10) -> DataFrame:
    """The most frequent word triples of each file, first seen first among equals."""
    texts = files.groupBy("path").agg(F.collect_list("content").alias("texts"))
    long = F.filter(F.transform("texts", lambda text: words(F.lower(text))), lambda t: F.size(t) >= 20)
    spots = lambda t: F.transform(_grams(t, 3), lambda gram, i: F.struct(gram.alias("gram"), i.alias("pos")))
    rows = settled(settled(texts.select("path", long.alias("t"))).select("path", F.sort_array(F.flatten(F.transform("t", spots))).alias("s")))
    # In sorted order, all but the last two of a triple's places are followed by it twice more, so only triples found three
    # times or more leave the row.
    again = F.filter("s", lambda g, i: F.coalesce(F.get("s", i + 2)["gram"] == g["gram"], F.lit(False)))
    counted = rows.select("path", F.inline(again)).groupBy("path", "gram").agg((F.count("*") + 2).alias("n"), F.min("pos").alias("first"))
    order = Window.partitionBy("path").orderBy(F.desc("n"), "first")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("path", "gram", "n", "rank")


def token_entropies(files: DataFrame) -> DataFrame:
    """Bits per identifier; texts with too few identifiers count as 5.0."""
    tokens = settled(files.select("path", identifiers(F.lower("content"), F.col("language")).alias("t")))
    tokens = settled(tokens.select("path", F.size("t").alias("raw"), count_identifiers("t").alias("u")).select("path", "raw", "u.*"))
    enough = (F.col("raw") >= 30) & (F.col("n") >= 15)
    # Different tokens, as one text, and their numbers go to the path's row, and only of files with enough of them.
    rows = tokens.select("path", enough.alias("enough"), F.when(enough, F.struct("names", "counts")).alias("t"))
    rows = settled(rows.groupBy("path", "enough").agg(F.collect_list("t").alias("t")))
    # Where texts share a path, equal tokens stand together once sorted, and their numbers are added up.
    every = F.sort_array(F.flatten(F.transform("t", lambda t: F.zip_with(F.split(t["names"], " "), t["counts"], lambda w, c: F.struct(w.alias("name"), c.alias("n"))))))
    rows = settled(rows.select("path", "enough", F.get("t", F.lit(0))["counts"].alias("counts"), F.when(F.size("t") > 1, every).alias("t")))
    starts = F.filter(F.transform("t", lambda s, i: F.when((i == 0) | (s["name"] != F.get("t", i - 1)["name"]), i)), lambda i: i.isNotNull())
    rows = settled(rows.select("path", "enough", "counts", "t", starts.alias("starts")))
    added = F.transform("starts", lambda s, k: F.aggregate(F.slice(
        "t", s + 1, F.coalesce(F.get("starts", k + 1), F.size("t")) - s), F.lit(0), lambda acc, c: acc + c["n"]))
    rows = settled(rows.select("path", "enough", F.when(F.col("t").isNull(), F.col("counts")).otherwise(added).alias("counts")))
    rows = settled(rows.withColumn("n", F.aggregate("counts", F.lit(0), lambda acc, c: acc + c)))
    weighted = F.aggregate("counts", F.lit(0.0), lambda acc, c: acc + c * F.log2(c))
    return rows.select("path", F.when(F.col("enough"), F.log2("n") - weighted / F.col("n")).otherwise(F.lit(5.0)).alias("entropy"))


def token_entropy(files: DataFrame, entropies: DataFrame | None = None) -> DataFrame:
    """Entropy with its severity. ``entropies``: ``token_entropies``, if at hand."""
    e = F.col("entropy")
    return (token_entropies(files) if entropies is None else entropies).select(
        "path", F.round(e, 6).alias("entropy"),
        F.when(e < 3.0, F.lit("CRITICAL")).when(e < 4.0, F.lit("HIGH")).alias("severity"),
        F.when(e < 4.0, F.round(F.least(F.lit(0.85), (4.0 - e) / 4.0 + 0.5), 6)).alias("confidence"))


def halstead_counts(files: DataFrame, *keep: str) -> DataFrame:
    rows = settled(files.select("path", *keep, matches(F.col("content"), G.HALSTEAD_TOKEN).alias("_tokens")))
    rows = settled(rows.select("path", *keep, count_operators("_tokens").alias("_n")).select("path", *keep, "_n.n1", "_n.n2", "_n.big_n1", "_n.big_n2"))
    vocabulary, length = F.col("n1") + F.col("n2"), F.col("big_n1") + F.col("big_n2")
    volume = F.when(vocabulary > 0, length * F.log2(vocabulary)).otherwise(F.lit(0.0))
    difficulty = F.when(F.col("n2") > 0, (F.col("n1") / 2) * (F.col("big_n2") / F.col("n2"))).otherwise(F.lit(0.0))
    return rows.withColumn("volume", volume).withColumn("difficulty", difficulty) \
        .withColumn("effort", F.col("difficulty") * F.col("volume")).withColumn("bugs", F.col("volume") / 3000)


def halstead(files: DataFrame) -> DataFrame:
    return halstead_counts(files).select(
        "path", "n1", "n2", "big_n1", "big_n2", F.round("volume", 4).alias("volume"),
        F.round("difficulty", 4).alias("difficulty"), F.round("effort", 2).alias("effort"), F.round("bugs", 6).alias("bugs"),
        (F.col("volume") > 1000).alias("high_volume"), (F.col("difficulty") > 30).alias("high_difficulty"),
        F.when(F.col("bugs") > 2.0, F.lit("HIGH")).when(F.col("bugs") > 1.0, F.lit("MEDIUM")).alias("bug_severity"))


def _plain_lines(content: Column, language: Column, variant: str = "statistical") -> Column:
    return F.filter(F.split(content, "\n", -1), lambda l: ~is_comment(variant, l, language))


def diversity_counts(files: DataFrame) -> DataFrame:
    plain = _plain_lines(F.col("content"), F.col("language"))
    tokens = F.flatten(F.transform(plain, lambda l: matches(F.lower(l), r"\b([a-z_][a-z0-9_]{2,})\b", group=1)))
    return settled(settled(files.select("path", tokens.alias("t"))).select(
        "path", F.size("t").alias("tokens"), F.size(F.array_distinct("t")).alias("unique_tokens")))


def token_diversity(files: DataFrame) -> DataFrame:
    """Type-token ratio and Guiraud index of files with at least 20 tokens."""
    rows = diversity_counts(files).where("tokens >= 20")
    ttr = F.try_divide("unique_tokens", "tokens")  # a pushed filter may ask for it before the number of tokens
    return rows.select("path", "tokens", "unique_tokens", F.round(ttr, 9).alias("ttr"),
                       F.round(F.col("unique_tokens") / F.sqrt("tokens"), 9).alias("guiraud"),
                       F.when(ttr < 0.3, F.lit("CRITICAL")).when(ttr < 0.5, F.lit("HIGH")).alias("severity"),
                       F.when(ttr < 0.5, F.round(F.least(F.lit(0.88), (0.5 - ttr) * 2 + 0.5), 9)).alias("confidence"))


def nesting(files: DataFrame) -> DataFrame:
    """Deepest nesting and its first line: indents in Python, brackets elsewhere."""
    lines_ = F.split("content", "\n", -1)
    depth = lambda l: F.when(F.contains(l, F.lit("\t")), occurrences(F.left(l, indent(l)), "\t")) \
        .otherwise(F.floor(indent(l) / 4).cast("int"))
    by_indent = F.aggregate(
        F.transform(lines_, lambda l: F.when(F.length(strip(l)) > 0, depth(l)).otherwise(F.lit(0))),
        F.struct(F.lit(0).alias("line"), F.lit(0).alias("top"), F.lit(0).alias("at")),
        lambda acc, d: F.struct((acc["line"] + 1).alias("line"), F.greatest(acc["top"], d).alias("top"),
                                F.when(d > acc["top"], acc["line"] + 1).otherwise(acc["at"]).alias("at")),
        lambda acc: F.struct(acc["top"].alias("top"), acc["at"].alias("at")))
    signs = F.split(replaced(F.col("content"), r"[^{}()\n]", ""), "")
    by_bracket = F.aggregate(
        signs, F.struct(F.lit(0).alias("depth"), F.lit(1).alias("line"), F.lit(0).alias("top"), F.lit(0).alias("at")),
        lambda acc, c: F.struct(
            F.when(c.isin("{", "("), acc["depth"] + 1).when(c.isin("}", ")"), F.greatest(acc["depth"] - 1, F.lit(0)))
            .otherwise(acc["depth"]).alias("depth"),
            (acc["line"] + F.when(c == "\n", 1).otherwise(0)).alias("line"),
            F.when(c.isin("{", "("), F.greatest(acc["top"], acc["depth"] + 1)).otherwise(acc["top"]).alias("top"),
            F.when(c.isin("{", "(") & (acc["depth"] + 1 > acc["top"]), acc["line"]).otherwise(acc["at"]).alias("at")),
        lambda acc: F.struct(acc["top"].alias("top"), acc["at"].alias("at")))
    deepest = F.when(F.col("language") == "python", by_indent).otherwise(by_bracket)
    return settled(files.select("path", deepest.alias("d"))).select("path", F.col("d.top").alias("depth"), F.col("d.at").alias("line_no"))


def nesting_depth(files: DataFrame) -> DataFrame:
    d = F.col("depth")
    return nesting(files).where(d >= 4).select(
        "path", "line_no", "depth",
        F.when(d >= 6, F.lit("CRITICAL")).when(d >= 5, F.lit("HIGH")).otherwise(F.lit("MEDIUM")).alias("severity"),
        F.when(d >= 6, F.lit(0.90)).when(d >= 5, F.lit(0.82)).otherwise(F.lit(0.72)).alias("confidence"))


# --- duplication -----------------------------------------------------------
def normal_lines(files: DataFrame) -> DataFrame:
    """Lower-cased, space-collapsed code lines of files with at least eight of them."""
    language = F.col("language")
    kept = F.filter(strip_each(F.split("content", "\n", -1)),
                    lambda l: (F.length(l) > 0) & ~is_comment("statistical", l, language))
    norm = F.transform(kept, lambda l: F.regexp_replace(F.lower(l), r"(?U)\s+", " "))
    return files.select("path", norm.alias("norm")).where(F.size("norm") >= WINDOW_LINES * 2)


def duplicate_blocks(files: DataFrame, top: int | None = None) -> DataFrame:
    """Exact repeats, then each block's first similar later block, in this order per file; ``top`` rows of it, if given.

    A file is one row, and its blocks are compared in its task: nothing is shuffled.
    """
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(path, rank, a + 1, b + 1, similarity) for path, norm in zip(*(c.to_pylist() for c in batch.columns))
                    for rank, (a, b, similarity) in enumerate(islice(each_repeat(norm), top), 1)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["path", "rank", "start_a", "start_b", "similarity"])

    found = normal_lines(files).mapInArrow(compare, "path string, rank long, start_a long, start_b long, similarity double")
    rows = found.select("path", *[F.col(c).cast("int").alias(c) for c in ("rank", "start_a", "start_b")], "similarity")
    return rows.select(
        "path", "rank", "start_a", "start_b", F.round("similarity", 9).alias("similarity"),
        F.when(F.col("similarity") >= 0.9, F.lit("HIGH")).otherwise(F.lit("MEDIUM")).alias("severity"),
        F.round(F.col("similarity") * 0.85, 9).alias("confidence"))


def adjacent_similarity(files: DataFrame) -> DataFrame:
    """Word-set similarity of each normalised line and the next one."""
    pairs = normal_lines(files).select("path", F.posexplode(F.arrays_zip(
        F.expr("slice(norm, 1, size(norm) - 1)").alias("x"), F.expr("slice(norm, 2, size(norm) - 1)").alias("y"))).alias("pos", "p"))
    a, b = F.array_distinct(F.split(F.col("p.x"), " ")), F.array_distinct(F.split(F.col("p.y"), " "))
    shared = F.size(F.array_intersect(a, b))
    value = shared / (F.size(a) + F.size(b) - shared)
    return pairs.select("path", (F.col("pos") + 1).alias("line_no"), F.round(value, 9).alias("similarity")) \
        .where("similarity > 0")


# --- complexity over lines ---------------------------------------------------
def _is_def(line: Column) -> Column:
    return found(line, G.PYTHON_DEF)


def _times(text: Column, needle: str) -> Column:
    """``occurrences`` for texts that mostly lack the needle."""
    return F.when(F.contains(text, F.lit(needle)), occurrences(text, needle)).otherwise(F.lit(0))


def _decisions(low: Column, script: Column) -> Column:
    """Decision words of a lower-cased line, at most three of each."""
    count = lambda keys: reduce(lambda a, b: a + b, [F.least(F.lit(3), _times(low, k)) for k in keys])
    return F.when(script, count(G.DECISION_WORDS["javascript"])).otherwise(count(G.DECISION_WORDS["python"]))


def def_sections(files: DataFrame) -> DataFrame:
    """``(path, language, seg_no, start_line, name, lines)``: the pieces that begin with a ``def``; the head has no name."""
    return settled(segments(files, _is_def).withColumn(
        "name", F.when(_is_def(F.element_at("lines", 1)), capture(F.element_at("lines", 1), G.PYTHON_DEF))))


def _complexity(language: Column) -> Column:
    """Keyword complexity of a section's lines after the first; null for a file's head."""
    script = F.coalesce(language.isin("javascript", "typescript", "java"), F.lit(False))
    low = F.transform(F.expr("slice(lines, 2, size(lines))"), F.lower)
    return F.when(F.col("name").isNotNull(), F.aggregate(low, F.lit(1), lambda acc, l: acc + _decisions(l, script)))


def line_complexity(files: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """Keyword complexity of every ``def`` section. ``sections``: ``cognitive_segments`` with it, if at hand."""
    rows = settled(def_sections(files).withColumn("complexity", _complexity(F.col("language")))) if sections is None else sections
    return rows.where(F.col("name").isNotNull()).select("path", F.col("start_line").alias("line_no"), "name", "complexity")


def complexity_level(score: Column) -> tuple[Column, Column]:
    return (F.when(score > 20, F.lit("CRITICAL")).when(score > 15, F.lit("HIGH")).otherwise(F.lit("MEDIUM")),
            F.when(score > 20, F.lit(0.92)).when(score > 15, F.lit(0.85)).otherwise(F.lit(0.75)))


def cyclomatic_lines(files: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """Sections of high complexity. ``sections``: ``cognitive_segments`` with their complexity, if at hand."""
    severity, confidence = complexity_level(F.col("complexity"))
    return line_complexity(files, sections).where("complexity > 10").select(
        "path", "line_no", "name", "complexity", severity.alias("severity"), confidence.alias("confidence"))


def cognitive_segments(files: DataFrame, complexity: bool = False) -> DataFrame:
    """Cognitive score, and with ``complexity`` the keyword complexity, of every ``def`` section (section 0 is the file's head).

    Each line is reduced to (opens, closes, flat points); a fold then walks the
    nesting level, which never falls below zero.
    """
    cut = def_sections(files)

    def step(text: Column) -> Column:
        plain_if = found(text, r"^\s*if\s+") & ~F.contains(text, F.lit("else"))
        elif_ = found(text, r"^\s*elif\s+")
        else_ = found(text, r"^\s*else\s*:")
        opening = plain_if | (~elif_ & ~else_ & found(text, r"^\s*(?:for\s+|while\s+|try\s*:)"))
        flat = ~opening & (elif_ | else_ | found(text, r"^\s*except\s+"))
        # Names before a bracket are cut out only where the section's own name and a bracket stand in the line.
        calls = matches(text, r"(\w+)\s*\(", group=1)
        recursion = F.when(F.contains(text, F.lit("(")) & F.contains(text, F.col("name")), F.array_contains(calls, F.col("name"))).otherwise(F.lit(False))
        ternary = _times(text, " if ") + _times(text, "?")
        points = flat.cast("int") + hits(text, r"\b(and|or|&&|\|\|)\b") + recursion.cast("int") \
            + F.greatest(ternary - 1, F.lit(0))
        return F.struct(opening.cast("int").alias("up"),
                        starts_with_any(text, ("return", "break", "continue", "raise")).cast("int").alias("down"),
                        points.alias("points"))

    walk = F.aggregate(
        F.transform(strip_each(F.col("lines")), step), F.struct(F.lit(0).alias("level"), F.lit(0).alias("score")),
        lambda acc, s: F.struct(
            F.greatest(acc["level"] + s["up"] - s["down"], F.lit(0)).alias("level"),
            (acc["score"] + s["points"] + s["up"] * (acc["level"] + 1)).alias("score")),
        lambda acc: acc["score"])
    more = [_complexity(F.col("language")).alias("complexity")] if complexity else []
    return settled(cut.select("path", "seg_no", "start_line", "name", walk.alias("score"), *more))


def cognitive(files: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """Each file's score with its severity. ``sections``: ``cognitive_segments``, if at hand."""
    total = F.col("total_score")
    rows = (cognitive_segments(files) if sections is None else sections).groupBy("path").agg(F.sum("score").alias("total_score"))
    return rows.select(
        "path", "total_score",
        F.when(total > 40, F.lit("CRITICAL")).when(total > 25, F.lit("HIGH")).when(total > 15, F.lit("MEDIUM")).alias("severity"),
        F.when(total > 40, F.lit(0.90)).when(total > 25, F.lit(0.82)).when(total > 15, F.lit(0.72)).alias("confidence"))


def cognitive_hotspots(files: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """Up to three functions per file with a cognitive score above ten. ``sections``: ``cognitive_segments``, if at hand."""
    order = Window.partitionBy("path").orderBy(F.desc("score"), "seg_no")
    return (cognitive_segments(files) if sections is None else sections).where(F.col("name").isNotNull() & (F.col("score") > 10)) \
        .withColumn("rank", F.row_number().over(order)).where("rank <= 3") \
        .select("path", F.col("start_line").alias("line_no"), "name", "score", "rank")


def function_parameters(files: DataFrame) -> DataFrame:
    """Definitions with more than five parameters besides self and cls."""
    line = F.col("line")
    params = F.filter(F.transform(F.split(capture(line, G.PYTHON_DEF, 2), ","), strip),
                      lambda p: (F.length(p) > 0) & ~p.isin("self", "cls"))
    rows = lines(files).where(_is_def(line)).select(
        "path", "line_no", capture(line, G.PYTHON_DEF).alias("name"), F.size(params).alias("n"))
    return rows.where("n > 5").select("path", "line_no", "name", "n",
                                      F.when(F.col("n") > 7, F.lit("CRITICAL")).otherwise(F.lit("HIGH")).alias("severity"),
                                      F.lit(0.78).alias("confidence"))


def maintainability_scores(files: DataFrame) -> DataFrame:
    """Maintainability index 0-100 from volume, decision words, code and comment lines; volume, difficulty and bugs beside it."""
    language = F.col("language")
    # A file's lines are cut and stripped once; is_comment looks behind leading blanks by itself.
    rows = settled(files.select("path", "content", "language", F.filter(F.transform(F.split("content", "\n", -1), lstrip), lambda l: F.length(l) > 0).alias("_lines")))
    with_counts = settled(rows.select(
        "path", "content", F.size("_lines").alias("loc"),
        F.size(F.filter("_lines", lambda l: is_comment("statistical", l, language))).alias("comment_lines"),
        F.greatest(hits(F.col("content"), r"\b(if|elif|for|while|except|and|or)\b"), F.lit(1)).alias("cc")))
    rows = halstead_counts(with_counts, "loc", "comment_lines", "cc")
    loc = F.greatest(F.col("loc"), F.lit(1))
    share = F.col("comment_lines") / loc
    raw = 171 - 5.2 * F.log(F.greatest(F.col("volume"), F.lit(1.0))) - 0.23 * F.col("cc") - 16.2 * F.log(loc) \
        + 50 * F.sin(F.sqrt(2.4 * share))
    return rows.select("path", "loc", "comment_lines", "cc", F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)).alias("mi"),
                       "volume", "difficulty", "bugs")


def maintainability(files: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """The index with its severity. ``scores``: ``maintainability_scores``, if at hand."""
    mi = F.col("mi")
    return (maintainability_scores(files) if scores is None else scores).select(
        "path", "loc", "comment_lines", "cc", F.round(mi, 6).alias("mi"),
        F.when(mi < 20, F.lit("CRITICAL")).when(mi < 40, F.lit("HIGH")).alias("severity"),
        F.when(mi < 40, F.round(F.least(F.lit(0.85), (40 - mi) / 40 + 0.5), 6)).alias("confidence"))
