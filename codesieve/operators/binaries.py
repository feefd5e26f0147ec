"""Files as bytes: is it binary, in which encoding is it text, and what is known of it without reading it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.functions.frames import settled
from codesieve.functions.text import basename, suffix
from codesieve.operators.paths import detect_language, is_supported
from codesieve.rulebook import files as T

BOM8, BOM16_LITTLE, BOM16_BIG = b"\xef\xbb\xbf", b"\xff\xfe", b"\xfe\xff"
#: Characters, one for each byte, that are no text; and those that are neither printed nor blank.
CONTROL, UNPRINTED = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "[\\x00-\\x08\\x0E-\\x1B\\x7F-\\x84\\x86-\\x9F\\xAD]"
#: 16-bit units as hex, low byte first and high byte first: single units outside the surrogates, or a pair of them.
UNITS_LITTLE = r"(?:[0-9A-F]{2}(?:[0-9A-CEF][0-9A-F]|D[0-7])|[0-9A-F]{2}D[89AB][0-9A-F]{2}D[C-F])*+"
UNITS_BIG = r"(?:(?:[0-9A-CEF][0-9A-F]|D[0-7])[0-9A-F]{2}|D[89AB][0-9A-F]{2}D[C-F][0-9A-F]{2})*+"


def _one_per_byte(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")


def _without(text: Column, characters: str) -> Column:
    return F.length(F.regexp_replace(text, F.lit("(?s)" + characters), F.lit("")))


def valid_utf8(data: Column) -> Column:
    return F.is_valid_utf8(data.cast("string"))


def _starts(data: Column, head: bytes) -> Column:
    return F.startswith(data, F.lit(head))


def binary_reason(path: Column, data: Column, header: int | None = 512) -> Column:
    """Why a file counts as binary, null for text: extension, signature, control, encoding; ``unreadable`` for null bytes.

    A header of 512 bytes decides, as sniffing is meant to be cheap; with ``header=None`` all bytes do. A character that the
    header cuts is no valid UTF-8; such a header counts as text by its share of printed characters. Empty files are text.
    """
    head = data if header is None else F.substring(data, 1, header)
    plain = _one_per_byte(head)
    size = F.octet_length(head)
    signature = reduce(lambda a, b: a | b, [_starts(head, bytes.fromhex(h)) for h in T.BINARY_HEADERS])
    return F.when(F.lower(suffix(path)).isin(T.BINARY_EXTENSIONS), F.lit("extension")).when(data.isNull(), F.lit("unreadable")) \
        .when(signature, F.lit("signature")).when(size == 0, F.lit(None)) \
        .when(size - _without(plain, CONTROL) > 0.3 * size, F.lit("control")).when(valid_utf8(head), F.lit(None)) \
        .when(_without(plain, UNPRINTED) > 0.7 * size, F.lit(None)).otherwise(F.lit("encoding"))


def sniffed(files: DataFrame, header: int | None = 512) -> DataFrame:
    """``(path, is_binary, reason)`` of files with a binary column ``bytes``."""
    rows = settled(files.select("path", binary_reason(F.col("path"), F.col("bytes"), header).alias("reason")))
    return rows.select("path", F.col("reason").isNotNull().alias("is_binary"), "reason")


def _utf16(data: Column) -> tuple[Column, Column]:
    """(can it be read, text) as UTF-16; without a mark the low byte comes first."""
    big, marked = _starts(data, BOM16_BIG), _starts(data, BOM16_BIG) | _starts(data, BOM16_LITTLE)
    body = F.when(marked, F.substring(data, 3, 2_147_483_647)).otherwise(data)
    fits = lambda units: F.regexp_like(F.hex(body), F.lit("^" + units + "$"))
    valid = (F.octet_length(body) % 2 == 0) & F.when(big, fits(UNITS_BIG)).otherwise(fits(UNITS_LITTLE))
    return valid, F.when(big, F.decode(body, "UTF-16BE")).otherwise(F.decode(body, "UTF-16LE"))


def decoded(files: DataFrame, newlines: bool = True) -> DataFrame:
    """``(path, encoding, content)``: bytes read as UTF-8 (a mark at the start goes), else UTF-16, else Latin-1, which takes all.

    Each form is tried only where those before it fail, on whole files. With ``newlines``, the ends of lines become line
    feeds. Null bytes give nulls, empty files an empty UTF-8 text. Other columns are not looked at.
    """
    data = F.col("bytes")
    valid, wide = _utf16(data)
    rows = settled(files.select("path", data, F.when(data.isNull(), F.lit(None)).when(valid_utf8(data), F.lit("utf-8")).when(valid, F.lit("utf-16"))
                                .otherwise(F.lit("latin-1")).alias("encoding")))
    kind = F.col("encoding")
    eight = F.when(_starts(data, BOM8), F.substring(data, 4, 2_147_483_647)).otherwise(data).cast("string")
    text = F.when(kind == "utf-8", eight).when(kind == "utf-16", wide).when(kind == "latin-1", _one_per_byte(data))
    if newlines:
        text = F.regexp_replace(text, F.lit("\r\n?"), F.lit("\n"))
    return settled(rows.select("path", "encoding", text.alias("content")))


def text_files(spark: SparkSession, folder: str, pattern: str = "*", header: int | None = 512) -> DataFrame:
    """``(path, language, encoding, content)`` of the text files under a folder whose names fit the pattern."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    files = files.select("path", F.col("content").alias("bytes"))
    texts = decoded(files.where(binary_reason(F.col("path"), F.col("bytes"), header).isNull()))
    return texts.select("path", detect_language(F.col("path"), F.col("content")).alias("language"), "encoding", "content")


def file_info(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``(path, name, extension, language, size_bytes, size_kb, modified, is_supported)`` of the files under a folder.

    Names are pruned while listing and contents are never read: the scan's columns are the path, the length and the time.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    path, name = F.col("path"), basename(F.col("path"))
    language = detect_language(path, F.lit(""))
    return files.select(path, name.alias("name"), suffix(path).alias("extension"), language.alias("language"), F.col("length").alias("size_bytes"),
                        F.round(F.col("length") / 1024, 2).alias("size_kb"), F.col("modificationTime").alias("modified"), is_supported(language).alias("is_supported"))
