"""Predicates and lookups on file paths, names and import specifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions.text import (any_glob, basename, found, glob_regex, lookup, replaced, strip,
                                      suffix, text_array)
from codesieve.rulebook import files as T


def _votes(text: Column, words) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("int") for w in words])


def first_lines(content: Column, n: int = 50) -> Column:
    return F.substring_index(content, "\n", n)


def detect_language(path: Column, content: Column) -> Column:
    """Special names, binary extensions, content votes for shared extensions, table."""
    name, ext = basename(path), F.lower(suffix(path))
    sample = first_lines(content)
    low = F.lower(sample)
    has_sample = F.length(sample) > 0
    matlab = _votes(low, T.MATLAB_WORDS) > _votes(sample, T.OBJC_WORDS)
    verilog = _votes(low, T.VERILOG_WORDS) > _votes(low, T.VLANG_WORDS)
    return F.coalesce(lookup(name, T.SPECIAL_NAMES),
                      F.when(ext.isin(T.BINARY_EXTENSIONS), F.lit("binary")),
                      F.when(has_sample & (ext == ".m"), F.when(matlab, F.lit("matlab")).otherwise(F.lit("objective-c"))),
                      F.when(has_sample & (ext == ".v"), F.when(verilog, F.lit("verilog")).otherwise(F.lit("vlang"))),
                      F.when(has_sample & (ext == ".h"), F.when(_votes(low, T.CPP_WORDS) > 0, F.lit("cpp")).otherwise(F.lit("c"))),
                      lookup(ext, T.LANGUAGES), F.lit("unknown"))


def language_for_path(path: Column) -> Column:
    """Reviewable language by extension, null for anything that is not code."""
    return lookup(F.lower(suffix(path)), T.REVIEW_LANGUAGES)


def is_supported(language: Column) -> Column:
    return ~language.isin("unknown", "binary")


def is_test_path(path: Column, extra: tuple[str, ...] = ()) -> Column:
    globs = any_glob([*T.TEST_GLOBS, *extra])
    return found(path, globs) | found(basename(path), globs)


def matches_globs(text: Column, globs) -> Column:
    return found(text, any_glob(globs))


def excluded_dir(path: Column) -> Column:
    """Is any folder of the path an excluded one?"""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    return F.arrays_overlap(folders, text_array(T.EXCLUDED_DIRS)) | F.exists(folders, lambda d: found(d, glob_regex("*.egg-info")))


def normalize_language(hint: Column) -> Column:
    return lookup(F.lower(strip(hint)), T.LANGUAGE_ALIASES)


def file_filter(files: DataFrame, extensions=(".py", ".js", ".ts", ".java"), exclude=(), max_kb: int | None = None) -> DataFrame:
    """Files a scan would read: extension, known language, not excluded; max_kb, if given, is a filter by size."""
    path, content = F.col("path"), F.col("content")
    keep = suffix(path).isin(list(extensions)) & is_supported(detect_language(path, content)) & ~excluded_dir(path)
    if max_kb is not None:
        keep = keep & (F.octet_length(content) <= max_kb * 1024)
    if exclude:
        keep = keep & ~(matches_globs(path, exclude) | matches_globs(basename(path), exclude))
    return files.where(keep)


def pep503(name: Column) -> Column:
    return F.lower(replaced(name, r"[-_.]+", "-"))


def js_package(specifier: Column) -> Column:
    """Package name of an import specifier; null for relative and alias paths."""
    parts = F.split(specifier, "/")
    scoped = F.when(F.size(parts) >= 2, F.concat_ws("/", F.element_at(parts, 1), F.try_element_at(parts, F.lit(2))))
    return F.when(found(specifier, r"^[./#]"), F.lit(None)).when(F.startswith(specifier, F.lit("node:")), specifier) \
        .when(F.startswith(specifier, F.lit("@")), scoped).otherwise(F.element_at(parts, 1))


def unquote_path(path: Column) -> Column:
    """Git-quoted path: C escapes and octal bytes, read as UTF-8.

    Every escape becomes hex bytes of its own and plain text becomes the hex of
    its UTF-8 form; the joined hex is decoded once.
    """
    quoted = found(path, r"^\".*\"$") & (F.length(path) >= 2)
    inner = F.substring(path, 2, F.greatest(F.length(path) - 2, F.lit(0)))
    tokens = F.regexp_extract_all(inner, F.lit(r"(?s)\\[0-9]{1,3}|\\.|[^\\]+"), F.lit(0))
    escapes = {"\\\\": "5C", '\\"': "22", "\\n": "0A", "\\t": "09", "\\r": "0D", "\\a": "07", "\\b": "08",
               "\\f": "0C", "\\v": "0B"}
    octal = lambda t: F.lpad(F.substring(F.conv(F.substring(t, 2, 3), 8, 16), -2, 2), 2, "0")
    as_hex = lambda t: F.coalesce(
        lookup(t, escapes), F.when(found(t, r"^\\[0-9]"), octal(t)),
        F.when(F.startswith(t, F.lit("\\")), F.hex(F.encode(F.substring(t, 2, 9), "UTF-8"))).otherwise(F.hex(F.encode(t, "UTF-8"))))
    decoded = F.decode(F.unhex(F.array_join(F.transform(tokens, as_hex), "")), "UTF-8")
    return F.when(quoted, F.coalesce(decoded, F.lit(""))).otherwise(path)


def strip_prefix(path: Column) -> Column:
    plain = unquote_path(path)
    return F.when(found(plain, r"^[ab]/"), F.substring(plain, 3, F.length(plain))).otherwise(plain)


def line_counts(files: DataFrame) -> DataFrame:
    """Total, blank and other lines; a final newline adds no line, comments count as code."""
    parts = F.split("content", r"(?U)\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]", -1)
    all_lines = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    blank = F.size(F.filter("l", lambda x: F.length(strip(x)) == 0))
    return files.select("path", all_lines.alias("l")).select(
        "path", F.size("l").alias("total"), blank.alias("blank"), (F.size("l") - blank).alias("code"), F.lit(0).alias("comments"))


def rename_identifiers(content: Column, names: dict[str, str]) -> Column:
    return reduce(lambda text, pair: replaced(text, rf"\b{pair[0]}\b", pair[1]), names.items(), content)


def snippet(lines_: Column, line_no: Column, around: int) -> Column:
    """Lines around a line, numbered to width four and marked with ``>>> ``."""
    first = F.greatest(F.lit(1), line_no - around)
    last = F.least(F.size(lines_), line_no + around)
    # Lines are looked up one by one: a slice would copy the whole file for each snippet.
    numbered = F.transform(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>")), lambda no: F.concat(
        F.when(no == line_no, F.lit(">>> ")).otherwise(F.lit("    ")),
        F.lpad(no.cast("string"), F.greatest(F.lit(4), F.length(no.cast("string"))), F.lit(" ")),
        F.lit(" | "), F.get(lines_, no - 1)))
    return F.array_join(numbered, "\n")


