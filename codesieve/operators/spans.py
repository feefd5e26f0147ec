"""String literals, docstrings and comments of Python texts, found lexically inside the file's row.

One alternation cuts a text into code and tokens. The tokens, each replaced by one character, leave a skeleton in which a
docstring is a string that opens the text or follows a header ``def ...:`` or ``class ...:``. Offsets and lines are running
sums of lengths, so all of it is linear in the text and stays in the JVM. A quote left open ends with its line (one of
three ends with the text); the letters before a quote (``rb``, ``f``) are code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions.frames import settled
from codesieve.functions.text import INSIDE_A, INSIDE_B, MARK, escaped, found, matches, replaced, rx, with_running_sums

#: A comment, or a string of three quotes or one; escapes skip a character.
TOKEN = (r"#[^\n]*+"
         r'|"""(?:[^\\"]++|\\[\s\S]|"(?!""))*+(?:"""|\\?\z)?' r"|'''(?:[^\\']++|\\[\s\S]|'(?!''))*+(?:'''|\\?\z)?"
         r'|"(?:[^"\\\n]++|\\[\s\S])*+"?+' r"|'(?:[^'\\\n]++|\\[\s\S])*+'?+")
COMMENT, STRING, DOCSTRING = "\x02", INSIDE_A, INSIDE_B
#: What stands before a docstring in the skeleton: nothing yet, or a header with parentheses up to three deep.
HEAD = (r"(\A[ \t\n\f\x02]*+|^[ \t]*+(?:async[ \t]++)?(?:def|class)\b"
        r"(?:[^\n():]|:(?![ \t]*+[\n\x02\x03])|\((?:[^()]|\((?:[^()]|\([^()]*+\))*+\))*+\))*+:[ \t\n\x02]*+)" + STRING)
NAMES = {COMMENT: "comment", STRING: "string", DOCSTRING: "docstring"}
PYTHON = ("python", "py", "python3")


def pieces(text: Column) -> Column:
    """The text cut at its tokens in one search: code, token, code, token, ..., code. The text must be ``escaped``."""
    return F.split(replaced(text, TOKEN, MARK + "$0" + MARK), MARK, -1)


def token_kinds(text: Column) -> Column:
    """One character per token: COMMENT, STRING or DOCSTRING. The text must be ``escaped``."""
    outside, tokens = F.split(text, rx(TOKEN), -1), matches(text, TOKEN)
    signs = F.transform(tokens, lambda t: F.when(F.startswith(t, F.lit("#")), F.lit(COMMENT)).otherwise(F.lit(STRING)))
    skeleton = F.array_join(F.zip_with(outside, signs, lambda o, s: F.concat(o, F.coalesce(s, F.lit("")))), "")
    told = F.regexp_replace(skeleton, F.lit(rx(HEAD, "m")), F.lit("$1" + DOCSTRING))
    return F.split(F.regexp_replace(told, "[^\\x02-\\x04]+", ""), "")


def tokens(files: DataFrame, *keep: str) -> DataFrame:
    """``(path, start, stop, first_line, last_line, kind)`` of every string, docstring and comment, offsets from 0.

    A file is one row until here; empty and null texts have no tokens, and a table without rows gives none.
    """
    rows = settled(files.select("path", *keep, escaped(F.coalesce("content", F.lit(""))).alias("text")))
    rows = settled(rows.select("path", *keep, F.split("text", rx(TOKEN), -1).alias("outside"), matches(F.col("text"), TOKEN).alias("inside"),
                               token_kinds(F.col("text")).alias("kinds")))
    turns = lambda measure: F.flatten(F.zip_with("outside", "inside", lambda o, t: F.array(measure(o), F.coalesce(measure(t), F.lit(0)))))
    breaks = lambda text: F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    rows = rows.withColumns({"lengths": turns(F.length), "lines": turns(breaks)})
    rows = with_running_sums(with_running_sums(rows, "lengths", "at"), "lines", "line_at")
    spot = lambda name, i: F.get(F.col(name), 2 * i)
    spans = F.transform("inside", lambda t, i: F.struct(
        spot("at", i).alias("start"), (spot("at", i) + F.length(t)).alias("stop"), (spot("line_at", i) + 1).alias("first_line"),
        (spot("line_at", i) + breaks(t) + 1).alias("last_line"), F.get("kinds", i).alias("sign")))
    out = rows.select("path", *keep, F.inline(spans))
    kind = F.when(F.col("sign") == COMMENT, NAMES[COMMENT]).when(F.col("sign") == DOCSTRING, NAMES[DOCSTRING]).otherwise(NAMES[STRING])
    return out.select("path", *keep, "start", "stop", "first_line", "last_line", kind.alias("kind"))


def may_be_python(language: Column) -> Column:
    """Does the hint leave it open or say so? A test of the hint alone, that needs no text."""
    return F.coalesce(F.lower(F.btrim(language)).isin(*PYTHON, ""), F.lit(True))


def is_python(language: Column, content: Column) -> Column:
    """By the hint where there is one; else by the look of a text: a header with a colon at its line's end, and no braces' ends."""
    look = found(content, r"^[ \t]*+(?:def|class|import|from)[ \t]+\w", "m") & ~found(content, r"[;{}][ \t]*+$", "m")
    return F.when(F.length(F.btrim(language)) > 0, F.lower(F.btrim(language)).isin(*PYTHON)).otherwise(look)
