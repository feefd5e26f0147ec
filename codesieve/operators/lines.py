"""Lines of files and the per-line masks that detectors share.

Masks that depend on earlier lines (docstrings, fences, block comments) are
computed inside the file's own row by splitting the text at the delimiter and
tagging the line breaks of the inside pieces.  That keeps them linear in the
text and free of any shuffle or window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions.frames import settled
from codesieve.functions.text import (INSIDE_A, INSIDE_B, MARK, escaped, folded, found, held_signs, lstrip,
                                      matches, replaced, restored, rx, starts_with_any, strip)

HASH = ("#",)
SLASH = ("//", "/*")
SLASH_STAR = ("//", "/*", "*")
TRIPLE = ('"""', "'''")

#: Which prefixes start a comment line, per detector and language.
COMMENT_PREFIXES = {
    "security": ([(("python", "ruby"), HASH),
                  (("javascript", "typescript", "java", "csharp", "c", "cpp", "go"), SLASH)], ("#", "//")),
    "pattern": ([(("python",), HASH), (("javascript", "typescript"), SLASH),
                 (("java", "csharp"), SLASH_STAR)], ("#", "//", "/*", "*")),
    "semantic": ([(("python", "ruby"), HASH),
                  (("javascript", "typescript", "java", "csharp"), SLASH_STAR)], ()),
    "antipattern": ([(("python", "ruby", "perl", "shell", "bash"), HASH),
                     (("javascript", "typescript", "java", "c", "cpp", "csharp", "go", "rust"), SLASH_STAR)],
                    ("#", "//")),
    "statistical": ([(("python",), ("#", *TRIPLE)),
                     (("javascript", "typescript", "java", "csharp"), SLASH_STAR)], ("#", "//")),
    "emoji": ([(("python", "ruby"), HASH),
               (("javascript", "typescript", "java", "csharp"), SLASH_STAR)], ()),
}


def is_comment(variant: str, line: Column, language: Column) -> Column:
    """Does the line start a comment, by the named detector's own rule?"""
    groups, default = COMMENT_PREFIXES[variant]
    text = lstrip(line)
    expr = None
    for languages, prefixes in groups:
        test = starts_with_any(text, prefixes)
        cond = language.isin(list(languages))
        expr = F.when(cond, test) if expr is None else expr.when(cond, test)
    return expr.otherwise(starts_with_any(text, default) if default else F.lit(False))


def lines(files: DataFrame, *keep: str) -> DataFrame:
    """``(path, language, line_no, line)``; the content itself is dropped here."""
    return files.select("path", "language", *keep, F.posexplode(F.split("content", "\n", -1)).alias("pos", "line")) \
        .withColumn("line_no", F.col("pos") + 1).drop("pos")


def with_low(rows: DataFrame, text: str = "line") -> DataFrame:
    """Rows plus the folded text that guards of case-ignoring rules read."""
    return settled(rows.withColumn("low", folded(F.col(text))))


def with_signs(rows: DataFrame, text: str = "line") -> tuple[DataFrame, dict[str, Column]]:
    """Rows plus one flag for each sign that rules need, and the flags by sign."""
    tests = held_signs(F.col(text))
    names = {s: f"_sign_{k}" for k, s in enumerate(tests)}
    return settled(rows.withColumns({names[s]: test for s, test in tests.items()})), {s: F.col(n) for s, n in names.items()}


def _tag_inside(text: Column, delimiter: str, tag: str) -> Column:
    """Tag every line that starts inside a toggling delimiter pair."""
    pieces = F.split(text, rx(delimiter), -1)
    glue = F.concat(F.array(F.lit("")), matches(text, delimiter))
    tagged = F.transform(pieces, lambda piece, i: F.when(
        i % 2 == 1, F.replace(piece, F.lit("\n"), F.lit("\n" + tag))).otherwise(piece))
    return F.array_join(F.zip_with(glue, tagged, lambda d, piece: F.concat(d, piece)), "")


def _tag_block_comments(text: Column, tag: str) -> Column:
    """Tag lines inside ``/* ... */``.

    The rule works on whole lines: a line that opens without any close starts
    the block, and the next line holding a close ends it.
    """
    opened = F.split(replaced(text, r"^(?=[^\n]*/\*)(?![^\n]*\*/)", MARK, "m"), MARK, -1)

    def inside(piece: Column, i: Column) -> Column:
        head = F.substring_index(piece, "*/", 1)
        tail = F.substring(piece, F.length(head) + 1, F.length(piece))
        return F.when(i > 0, F.concat(F.replace(head, F.lit("\n"), F.lit("\n" + tag)), tail)).otherwise(piece)

    return F.array_join(F.transform(opened, inside), "")


ESCAPE_AWARE_DOUBLE = r'(?<!\\)"""'
ESCAPE_AWARE_SINGLE = r"(?<!\\)'''"


def masked_lines(files: DataFrame) -> DataFrame:
    """Lines plus ``in_docstring`` (triple quotes, or block comments in C-like code)."""
    language, content = F.col("language"), F.col("content")
    quoted = language.isin("python", "javascript", "typescript")
    curly = language.isin("java", "csharp", "go", "rust", "c", "cpp")
    # Each delimiter is looked for once, and only in texts that hold it.
    holds = lambda sign: F.contains(content, F.lit(sign))
    rows = settled(files.select("path", "language", escaped(content).alias("content")))
    rows = settled(rows.withColumn("content", F.when(quoted & holds(TRIPLE[0]), _tag_inside(content, ESCAPE_AWARE_DOUBLE, INSIDE_A)).otherwise(content)))
    tagged = F.when(quoted & holds(TRIPLE[1]), _tag_inside(content, ESCAPE_AWARE_SINGLE, INSIDE_B)) \
        .when(curly & holds("/*"), _tag_block_comments(content, INSIDE_A)).otherwise(content)
    raw = lines(settled(rows.select("path", "language", tagged.alias("content"))))
    line = F.col("line")
    # Tags sit at the line start, single quotes (applied last) first.
    inside = starts_with_any(line, (INSIDE_A, INSIDE_B))
    touches = F.when(quoted, found(line, ESCAPE_AWARE_DOUBLE) | found(line, ESCAPE_AWARE_SINGLE)) \
        .when(curly, (F.contains(line, F.lit("/*")) & ~F.contains(line, F.lit("*/"))) | F.contains(line, F.lit("*/"))) \
        .otherwise(F.lit(False))
    # Settled, so that filters on the line don't make one method too large for the JVM to compile.
    return settled(raw.select("path", "language", "line_no", (inside | touches).alias("in_docstring"),
                              restored(F.when(inside, F.translate(line, INSIDE_A + INSIDE_B, "")).otherwise(line)).alias("line")))


def context(line: Column, width: int = 100) -> Column:
    return F.left(strip(line), F.lit(width))
