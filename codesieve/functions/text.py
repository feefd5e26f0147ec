"""Text helpers that stay inside the JVM.

Rules follow Python's regex semantics (Unicode classes, ``.`` stops only at
LF), so every pattern is prefixed with Java's UNIX_LINES and
UNICODE_CHARACTER_CLASS flags.  Patterns are always literals: Spark keeps the
compiled form of a literal pattern, but recompiles a pattern column per row.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions.frames import settled
from codesieve.functions.literals import QUOTE, RARE_SIGNS, SIGNS, TELLING, ahead, alternatives, lowered, required, signs

WHITESPACE = " \t\n\r\x0b\x0c"

#: Control characters used to mark positions inside a text before splitting it.
MARK = "\x01"
INSIDE_A = "\x03"
INSIDE_B = "\x04"
#: Marks that a text brings along are swapped for code points that no text may hold, one for one.
MARKS, HIDDEN = "\x01\x02\x03\x04", "\ufdd0\ufdd1\ufdd2\ufdd3"


def rx(pattern: str, flags: str = "") -> str:
    """Pattern with the flags that make Java agree with Python's ``re``."""
    return f"(?dU{flags}){ahead(pattern)}{pattern}"


def escaped(text: Column) -> Column:
    """The text without control characters that could be taken for marks; lengths and lines stay."""
    return F.when(text.rlike("[\\x01-\\x04]"), F.translate(text, MARKS, HIDDEN)).otherwise(text)


def restored(text: Column) -> Column:
    """Undo ``escaped``."""
    return F.when(text.rlike("[\ufdd0-\ufdd3]"), F.translate(text, HIDDEN, MARKS)).otherwise(text)


def with_running_sums(rows: DataFrame, lengths: str, name: str, block: int = 256) -> DataFrame:
    """Add the sums of all elements up to each one of an int array column.

    Appending to an array copies it, so sums are built in blocks: linear for any real row.
    """
    total = lambda c: F.aggregate(c, F.lit(0), lambda acc, n: acc + n)
    grown = lambda c, first: F.aggregate(c, F.array(first), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    n = F.size(lengths)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(block))).otherwise(F.array().cast("array<int>"))
    rows = settled(rows.withColumn("_blocks", F.transform(starts, lambda s: F.slice(F.col(lengths), s + 1, F.lit(block)))))
    rows = settled(rows.withColumn("_before", grown(F.transform("_blocks", total), F.lit(0))))
    sums = F.transform("_blocks", lambda b, k: F.slice(grown(b, F.get(F.col("_before"), k)), 2, F.lit(block)))
    return settled(rows.withColumn(name, F.flatten(sums)).drop("_blocks", "_before"))


def folded(text: Column) -> Column:
    """Lower-cased text for guards; the odd letters that match ``s`` and ``i`` are mapped."""
    plain = F.lower(F.replace(text, F.lit("\u0130"), F.lit("i")))
    return F.replace(F.replace(plain, F.lit("\u017f"), F.lit("s")), F.lit("\u0131"), F.lit("i"))


def guard(text: Column, pattern: str, flags: str = "", low: Column | None = None) -> Column | None:
    """Cheap test that every matching text passes; null when there is none.

    Patterns that ignore case need the folded text, computed once by the caller.
    """
    fold, literals = required(pattern, flags)
    base = low if fold else text
    if base is None:
        return None
    tests = [F.contains(base, F.lit(lit)) for lit in literals]
    others = alternatives(pattern, flags) if max(map(len, literals), default=0) < TELLING else ()
    if others:
        tests.append(contains_any(base, others))
    return reduce(lambda a, b: a & b, tests) if tests else None


def found(text: Column, pattern: str, flags: str = "", low: Column | None = None, held: dict[str, Column] | None = None) -> Column:
    """Does the text hold a match? ``held`` tells which of SIGNS the text holds, where the caller knows (``held_signs``)."""
    test = F.regexp_like(text, F.lit(rx(pattern, flags)))
    cheap = guard(text, pattern, flags, low)
    tests = [held[s] for s in signs(pattern)] if held else []
    return reduce(lambda a, b: a & b, [*tests, *([] if cheap is None else [cheap]), test])


def held_signs(text: Column) -> dict[str, Column]:
    """For each of SIGNS, whether the text holds it: one search for all rules that need it."""
    return {s: contains_any(text, QUOTE) if s == QUOTE else F.contains(text, F.lit(s)) for s in SIGNS}


def may_match(text: Column, low: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """Cheap test that every text passes in which one of the (pattern, flags) is found: a sign or literal of each."""
    needed, folds = set(), set()
    for pattern, flags in rules:
        fold, literals = required(pattern, flags)
        sign = next((s for s in signs(pattern) if s in RARE_SIGNS), None)
        if sign is None and not literals:
            return F.lit(True)
        if sign is None:
            (folds if fold else needed).add(literals[0])
        else:
            needed |= set(sign)
    return any_of([F.contains(text, F.lit(s)) for s in sorted(needed)] + [F.contains(low, F.lit(s)) for s in sorted(folds)])


def likely(text: Column, pattern: str, flags: str = "", low: Column | None = None) -> Column:
    """Test that every text with a match passes, and hardly another: on the folded text where case doesn't matter."""
    plain = lowered(pattern, flags) if low is not None else None
    if plain is None:
        return found(text, pattern, flags, low)
    cheap = guard(text, pattern, flags, low)
    test = F.regexp_like(low, F.lit(rx(*plain)))
    return test if cheap is None else cheap & test


def hits(text: Column, pattern: str, flags: str = "", low: Column | None = None) -> Column:
    """Number of non-overlapping matches."""
    count = F.regexp_count(text, F.lit(rx(pattern, flags)))
    cheap = guard(text, pattern, flags, low)
    return count if cheap is None else F.when(cheap, count).otherwise(F.when(text.isNotNull(), F.lit(0)))


def matches(text: Column, pattern: str, flags: str = "", group: int = 0) -> Column:
    """All matches (or one capture group of each) in order."""
    return F.regexp_extract_all(text, F.lit(rx(pattern, flags)), F.lit(group))


def capture(text: Column, pattern: str, group: int = 1, flags: str = "") -> Column:
    """First match's capture group, empty string when there is no match."""
    return F.regexp_extract(text, rx(pattern, flags), group)


def replaced(text: Column, pattern: str, by: str, flags: str = "") -> Column:
    return F.regexp_replace(text, F.lit(rx(pattern, flags)), F.lit(by))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(WHITESPACE))


def strip_each(texts: Column) -> Column:
    """``strip`` of each element. The search from the end is slow, so it is made only where a text ends with whitespace."""
    ends = lambda t: reduce(lambda a, b: a | b, [F.endswith(t, F.lit(c)) for c in WHITESPACE])
    return F.transform(F.transform(texts, lambda t: F.when(ends(t), F.rtrim(t, F.lit(WHITESPACE))).otherwise(t)), lstrip)


def indent(line: Column) -> Column:
    return F.length(line) - F.length(lstrip(line))


def occurrences(text: Column, needle: str) -> Column:
    """Count of a plain substring, without overlaps."""
    shorter = F.replace(text, F.lit(needle), F.lit(""))
    return ((F.length(text) - F.length(shorter)) / len(needle)).cast("int")


def starts_with_any(text: Column, prefixes: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(text, F.lit(p)) for p in prefixes])


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, list(conditions))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    return any_of(F.contains(text, F.lit(w)) for w in words)


def text_array(values: Iterable[str]) -> Column:
    """Literal string array; one folded literal instead of one call per value."""
    return F.split(F.lit("\x1e".join(values)), "\x1e")


def lookup(key: Column, table: dict, default=None) -> Column:
    """Literal map lookup; a missing key gives the default."""
    flat = [F.lit(part) for pair in table.items() for part in pair]
    value = F.element_at(F.create_map(*flat), key)
    return value if default is None else F.coalesce(value, F.lit(default))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Last dot extension of the basename, '' for none (a leading dot is no suffix)."""
    return capture(basename(path), r"^.+(\.[^.]+)$")


def glob_regex(pattern: str) -> str:
    """Shell-style glob (``*`` crosses ``/``) as an anchored regex in the common subset."""
    out = []
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        close = pattern.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif close > 0:
            body = pattern[i + 1 : close].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = close
        else:
            out.append("\\" + ch if ch in r".^$+{}()|[]\\" else ch)
        i += 1
    return "^" + "".join(out) + "$"


def any_glob(patterns: Iterable[str]) -> str:
    """One alternation for a whole glob list, so a path is matched once."""
    return "|".join(f"(?:{glob_regex(p)})" for p in patterns)


def jaccard(left: Column, right: Column) -> Column:
    """Set similarity of two token arrays."""
    union = F.size(F.array_union(left, right))
    return F.when(union > 0, F.size(F.array_intersect(left, right)) / union).otherwise(F.lit(0.0))
