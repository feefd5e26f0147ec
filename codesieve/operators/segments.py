"""Cutting a file into pieces that start at certain lines.

Lines get their number and, where a piece starts, a mark; the joined text is
then split at the marks.  Linear in the text and local to the file's row.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions.frames import settled
from codesieve.functions.text import MARK, escaped, restored


def segments(files: DataFrame, is_start: Callable[[Column], Column], *keep: str) -> DataFrame:
    """``(path, language, seg_no, start_line, lines)``; piece 0 precedes the first start."""
    numbered = F.transform(F.split(escaped(F.col("content")), "\n", -1), lambda line, i: F.concat(
        F.when(is_start(line), F.lit(MARK)).otherwise(F.lit("")), (i + 1).cast("string"), F.lit("\t"), line))
    cut = files.select("path", "language", *keep,
                       F.posexplode(F.split(F.array_join(numbered, "\n"), MARK, -1)).alias("seg_no", "piece"))
    rows = F.split(F.rtrim(restored(F.col("piece")), F.lit("\n")), "\n", -1)
    text_of = lambda row: F.substring(row, F.instr(row, "\t") + 1, F.length(row))
    return settled(cut.where(F.length("piece") > 0).select(
        "path", "language", *keep, "seg_no",
        F.substring_index("piece", "\t", 1).cast("int").alias("start_line"),
        F.transform(rows, text_of).alias("lines")))
