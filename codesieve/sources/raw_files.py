"""Files as bytes in several encodings, derived from the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.operators.binaries import BOM8, BOM16_BIG, BOM16_LITTLE
from codesieve.sources.tables import spread, table

EXTENSIONS = [".py", ".txt", ".js", ".md", ".c", ".dat", ".log", ".bin"]
PNG = bytes.fromhex("89504E470D0A1A0A")


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, bytes)``: each document as UTF-8, with a mark, as UTF-16 either way round, as Latin-1, and as no text at all."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    d = F.col("doc_id")
    text = F.concat(F.lit("# \U0001d11e\r\n"), F.col("text"))
    narrow = F.regexp_replace(F.concat(F.lit("# \xe9\r"), F.col("text")), "[^\\x00-\\xFF]", "?")
    digest = F.unhex(F.repeat(F.sha2("text", 256), (d % 5 + 1).cast("int")))
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, bytes) else p for p in parts])
    data = F.when(d % 8 == 0, F.encode(text, "UTF-8")).when(d % 8 == 1, join(BOM8, F.encode(text, "UTF-8"))) \
        .when(d % 8 == 2, join(BOM16_LITTLE, F.encode(text, "UTF-16LE"))).when(d % 8 == 3, join(BOM16_BIG, F.encode(text, "UTF-16BE"))) \
        .when(d % 8 == 4, F.encode(narrow, "ISO-8859-1")).when(d % 8 == 5, join(PNG, F.encode(F.col("text"), "UTF-8"))) \
        .when(d % 8 == 6, join(digest, F.unhex(F.repeat(F.lit("00"), (d % 7).cast("int"))))).otherwise(F.encode(F.repeat(F.lit("\x01\x02a"), (d % 400).cast("int")), "UTF-8"))
    extension = F.element_at(F.split(F.lit(",".join(EXTENSIONS)), ","), (F.floor(d / 8) % len(EXTENSIONS) + 1).cast("int"))
    return docs.select(F.concat(F.lit("raw/f"), d.cast("string"), extension).alias("path"), data.alias("bytes"))
