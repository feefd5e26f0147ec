"""Unified diffs as tables, parsed inside each diff's row.

A ``diff --git`` line always starts a file and a hunk header always starts a
hunk, so both are plain splits.  Inside a hunk the end is the later of the two
positions where the old and the new budget are spent, and new-file line numbers
are positions in the lines that are not removals.  Nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions.frames import settled
from codesieve.functions.text import contains_any, rx
from codesieve.operators.paths import is_test_path, strip_prefix

HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
LINE_BREAKS = r"\r\n|[\r\x0B\f\x1C-\x1E\x85  ]"
#: Each line break other than LF.
OTHER_BREAKS = ("\r", "\x0b", "\f", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")


def _starts(text: Column, prefix: str) -> Column:
    return F.startswith(text, F.lit(prefix))


def _git_paths(first_line: Column) -> tuple[Column, Column]:
    """Old and new path of the ``a/x b/y`` part."""
    at = F.instr(first_line, " b/")
    words = F.filter(F.split(first_line, r"\s+"), lambda w: F.length(w) > 0)
    pair = F.size(words) >= 2
    old = F.when(at > 0, F.substring(first_line, F.lit(1), at - 1)).when(pair, F.element_at(words, 1))
    new = F.when(at > 0, F.substring(first_line, at + 1, F.length(first_line))).when(pair, F.element_at(words, -1))
    return old, new


def _last_value(headers: Column, *prefixes: str) -> Column:
    """Path of the last header that carries one; /dev/null carries none."""
    def value(h: Column) -> Column:
        expr = None
        for p in prefixes:
            rest = F.substring(h, len(p) + 1, F.length(h))
            found = F.when(F.lit(p.startswith(("---", "+++"))) & (rest == "/dev/null"), F.lit(None)) \
                .otherwise(F.substring_index(rest, "\t", 1) if p.startswith(("---", "+++")) else rest)
            expr = F.when(_starts(h, p), found) if expr is None else expr.when(_starts(h, p), found)
        return expr
    values = F.filter(F.transform(headers, value), lambda v: v.isNotNull())
    return F.try_element_at(values, F.lit(-1))


def _plus(line: Column) -> Column:
    return _starts(line, "+")


def _minus(line: Column) -> Column:
    return _starts(line, "-")


def _note(line: Column) -> Column:
    return _starts(line, "\\")


def _unix(text: Column) -> Column:
    """The text with LF alone. Few texts hold another line break, and a plain search tells them."""
    return F.when(contains_any(text, OTHER_BREAKS), F.regexp_replace(text, LINE_BREAKS, "\n")).otherwise(text)


def _chomped(text: Column) -> Column:
    return F.when(F.endswith(text, F.lit("\n")), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)


def _hunk_head(rows: Column) -> Column:
    """struct(body, start, old_n, new_n) of a hunk's lines: the numbers are read once per hunk."""
    number = lambda g: F.regexp_extract(F.element_at(rows, 1), rx(HUNK), g)
    budget = lambda g: F.when(number(g) == "", F.lit(1)).otherwise(number(g).try_cast("int"))
    return F.struct(F.slice(rows, F.lit(2), F.size(rows)).alias("body"), number(3).try_cast("int").alias("start"),
                    budget(2).alias("old_n"), budget(4).alias("new_n"))


def _hunk_end(hunk: Column) -> Column:
    """struct(body, start, stop): the lines up to where both budgets are spent."""
    body = hunk["body"]
    where = lambda test: F.filter(F.transform(body, lambda l, i: F.when(test(l), i + 1)), lambda i: i.isNotNull())
    spent = lambda rows, n: F.when(n <= 0, F.lit(0)).otherwise(F.coalesce(F.try_element_at(rows, n), F.size(body)))
    stop = F.greatest(spent(where(lambda l: ~_plus(l) & ~_note(l)), hunk["old_n"]),
                      spent(where(lambda l: ~_minus(l) & ~_note(l)), hunk["new_n"]))
    return F.struct(body.alias("body"), hunk["start"].alias("start"), stop.alias("stop"))


def _hunk_lines(hunk: Column) -> Column:
    """struct(added array<struct<line_no,text>>, tail array<string>) of one hunk."""
    live = F.slice(hunk["body"], F.lit(1), hunk["stop"])
    fresh = F.transform(F.filter(live, lambda l: ~_minus(l) & ~_note(l)), lambda l, i: F.struct(
        (hunk["start"] + i).alias("line_no"), l.alias("raw")))
    added = F.transform(F.filter(fresh, lambda s: _plus(s["raw"])), lambda s: F.struct(
        s["line_no"].alias("line_no"), F.substring(s["raw"], F.lit(2), F.length(s["raw"])).alias("text")))
    return F.struct(added.alias("added"), F.slice(hunk["body"], hunk["stop"] + 1, F.size(hunk["body"])).alias("tail"))


def file_diffs(diffs: DataFrame) -> DataFrame:
    """``(diff_id, file_no, path, old_path, status, is_binary, added)`` per changed file."""
    # Each array is settled before it is read more than once: inside a lambda an expression is computed at every use.
    text = settled(diffs.select("diff_id", _unix(F.col("diff")).alias("text")))
    # A section ends before the line break that its successor's head follows; the last one also sheds its own.
    text = settled(text.withColumn("text", F.concat(F.lit("\n"), _chomped(F.col("text")))))
    sections = settled(text.select("diff_id", F.split(_chomped(F.col("text")), "\ndiff --git ", -1).alias("sections")))
    per_file = sections.select("diff_id", F.posexplode(F.slice("sections", F.lit(2), F.size("sections"))).alias("file_no", "section"))
    parts = settled(per_file.select("diff_id", "file_no", F.split("section", rx("\\n(?=" + HUNK[1:] + ")"), -1).alias("parts")))
    rows = settled(parts.select("diff_id", "file_no", F.transform("parts", lambda piece: F.split(piece, "\n", -1)).alias("parts")))
    rows = rows.select("diff_id", "file_no", F.element_at("parts", 1).alias("top"),
                       F.transform(F.slice("parts", F.lit(2), F.size("parts")), _hunk_head).alias("hunks"))
    rows = settled(settled(rows).withColumn("hunks", F.transform("hunks", _hunk_end)))
    rows = settled(rows.withColumn("hunks", F.transform("hunks", _hunk_lines))).withColumn("headers", F.concat(F.slice("top", F.lit(2), F.size("top")),
                                               F.flatten(F.transform("hunks", lambda h: h["tail"])))) \
        .withColumn("entries", F.flatten(F.transform("hunks", lambda h: h["added"])))
    rows = settled(rows.select("diff_id", "file_no", F.element_at("top", 1).alias("git"), "headers", "entries"))
    any_header = lambda *prefixes: F.exists("headers", lambda h: F.coalesce(*[
        F.when(_starts(h, p), F.lit(True)) for p in prefixes], F.lit(False)))
    old_git, new_git = _git_paths(F.col("git"))
    old = F.coalesce(_last_value(F.col("headers"), "rename from ", "--- "), old_git)
    new = F.coalesce(_last_value(F.col("headers"), "rename to ", "+++ "), new_git)
    rows = settled(rows.withColumn("old", old).withColumn("new", new))
    rows = settled(rows.withColumn("old", strip_prefix(F.col("old"))).withColumn("new", strip_prefix(F.col("new"))))
    old, new = F.col("old"), F.col("new")
    deleted, fresh = any_header("deleted file mode"), any_header("new file mode")
    status = F.when(deleted, F.lit("deleted")).when(fresh, F.lit("added")) \
        .when(any_header("rename from ", "rename to "), F.lit("renamed")).otherwise(F.lit("modified"))
    # Overlapping hunks (never written by git) give a line twice: the later one holds, the last of its line in sorted order.
    entries = F.col("entries")
    clash = F.size(F.array_distinct(F.transform(entries, lambda e: e["line_no"]))) < F.size(entries)
    placed = F.transform(entries, lambda e, i: F.struct(e["line_no"].alias("line_no"), i.alias("at"), e["text"].alias("text")))
    rows = settled(rows.select("*", status.alias("status"), any_header("Binary files ", "GIT binary patch").alias("is_binary"), deleted.alias("deleted"),
                               F.when(clash, F.array_sort(placed)).alias("placed")))
    last = F.filter("placed", lambda e, i: ~F.coalesce(F.get("placed", i + 1)["line_no"] == e["line_no"], F.lit(False)))
    added = F.when(F.col("placed").isNull(), entries).otherwise(F.transform(last, lambda e: F.struct(e["line_no"].alias("line_no"), e["text"].alias("text"))))
    deleted = F.col("deleted")
    return settled(rows.select("diff_id", "file_no", F.coalesce(F.when(deleted, old).otherwise(F.coalesce(new, old)), F.lit("")).alias("path"),
                       F.coalesce(old, F.lit("")).alias("old_path"), "status", "is_binary", added.alias("added")))


def added_lines(files: DataFrame) -> DataFrame:
    return files.select("diff_id", "file_no", "path", F.inline("added"))


def tests_touched(files: DataFrame, extra: tuple[str, ...] = ()) -> Column:
    """Is this file a test with added lines?"""
    return is_test_path(F.col("path"), extra) & (F.size("added") > 0)
