"""Literals a pattern cannot match without.

A plain substring test is far cheaper than a regex scan, so every regex is
guarded by the literals that each of its matches must contain.
"""

from __future__ import annotations

import re
from functools import lru_cache

try:
    from re import _constants as c
    from re import _parser as parser
except ImportError:  # no parser, no guard: the regex alone decides
    parser = None

MAX_GUARDS = 2
#: Alternatives that a guard tries at most, and the letters that make a literal tell much.
MAX_CHOICES, TELLING = 12, 3


def _runs(items) -> list[str]:
    """Mandatory literal runs of a parsed sequence."""
    out, run = [], ""
    for op, arg in items:
        if op is c.LITERAL:
            run += chr(arg)
            continue
        if run:
            out.append(run)
            run = ""
        if op is c.SUBPATTERN:
            out += _runs(arg[3])
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT) and arg[0] >= 1:
            out += _runs(arg[2])
    return out + [run] if run else out


def _choices(items) -> list[set[str]]:
    """Sets of literals of a parsed sequence, one of each of which every match contains."""
    out = []
    for op, arg in items:
        if op is c.SUBPATTERN:
            out += _choices(arg[3])
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT) and arg[0] >= 1:
            out += _choices(arg[2])
        elif op is c.BRANCH:
            picked = [_one_literal(branch) for branch in arg[1]]
            if all(picked):
                out.append(set().union(*picked))
    return out


def _one_literal(items) -> set[str]:
    """The longest literal of a branch, or what one of its own alternatives must hold; empty when it can't be told."""
    runs = [run for run in _runs(items) if run.isascii()]
    if runs:
        return {max(runs, key=lambda run: (len(run), run))}
    return min(_choices(items), key=lambda s: (len(s), sorted(s)), default=set())


@lru_cache(maxsize=None)
def alternatives(pattern: str, flags: str = "") -> tuple[str, ...]:
    """Literals of an alternation, one of which every match contains; none when it cannot be told or there are too many."""
    if parser is None:
        return ()
    try:
        tree = parser.parse(pattern)
    except (re.error, OverflowError):
        return ()
    fold = "i" in flags or bool(tree.state.flags & re.IGNORECASE)
    sets = [{run.lower() if fold else run for run in s} for s in _choices(tree)]
    sets = [s for s in sets if len(s) <= MAX_CHOICES and all(run.isascii() for run in s)]
    return tuple(sorted(max(sets, key=lambda s: (min(map(len, s)), -len(s), sorted(s)), default=())))


#: An inline flag group that opens a pattern, and what has no plain form in lower case: numbered escapes and references,
#: named groups, ranges from a letter to a sign.
INLINE = re.compile(r"\(\?([a-z]+)\)")
UNPLAIN = re.compile(r"\\[xuUNpPkgc0-9]|\(\?P|[A-Za-z]-[^A-Za-z\]]|[^A-Za-z\[]-[A-Za-z]")


@lru_cache(maxsize=None)
def lowered(pattern: str, flags: str = "") -> tuple[str, str] | None:
    """Pattern and flags that find in folded text what the pattern finds without regard to case; None where it minds case.

    A search that ignores case compares letter by letter; one without can skip ahead by the literal it begins with.
    """
    inline = INLINE.match(pattern)
    body, every = (pattern[inline.end():], flags + inline[1]) if inline else (pattern, flags)
    if "i" not in every or not body.isascii() or UNPLAIN.search(body) or INLINE.search(body):
        return None
    return re.sub(r"\\.|[A-Z]", lambda m: m[0] if m[0][0] == "\\" else m[0].lower(), body, flags=re.S), "".join(sorted(set(every) - {"i"}))


#: Signs that most patterns of code need and prose rarely holds; QUOTE stands for either quote.
QUOTE = "\"'"
SIGNS = ("(", "=", "<", "{", "[", "$", QUOTE, "_", "-", "#", ".")
RARE_SIGNS = SIGNS[:7]


def _signs(items) -> set[str]:
    """Signs that each match of a parsed sequence holds."""
    out = set()
    for op, arg in items:
        if op is c.LITERAL:
            out.add(QUOTE if chr(arg) in QUOTE else chr(arg))
        elif op is c.IN and all(o is c.LITERAL and chr(a) in QUOTE for o, a in arg):
            out.add(QUOTE)
        elif op is c.SUBPATTERN:
            out |= _signs(arg[3])
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT) and arg[0] >= 1:
            out |= _signs(arg[2])
        elif op is c.BRANCH:
            out |= set.intersection(*[_signs(branch) for branch in arg[1]])
    return out


@lru_cache(maxsize=None)
def signs(pattern: str) -> tuple[str, ...]:
    """Those of SIGNS that each match of a pattern holds; none when it cannot be told."""
    if parser is None:
        return ()
    try:
        return tuple(s for s in SIGNS if s in _signs(parser.parse(pattern)))
    except (re.error, OverflowError):
        return ()


def _firsts(items) -> set[str] | None:
    """What a match of a parsed sequence may begin with, as parts of a character class; None when it can't be told."""
    for op, arg in items:
        if op is c.LITERAL:
            return {re.escape(chr(arg))} if chr(arg).isascii() else None
        if op is c.SUBPATTERN:
            return None if arg[1] or arg[2] else _firsts(arg[3])
        if op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
            return _firsts(arg[2]) if arg[0] >= 1 else None
        if op is c.BRANCH:
            sets = [_firsts(branch) for branch in arg[1]]
            return None if None in sets else set().union(*sets)
        if op is c.IN:
            parts = [re.escape(chr(a)) if o is c.LITERAL and a < 128 else f"{re.escape(chr(a[0]))}-{re.escape(chr(a[1]))}"
                     if o is c.RANGE and a[1] < 128 else r"\d" if (o, a) == (c.CATEGORY, c.CATEGORY_DIGIT) else None for o, a in arg]
            return None if None in parts else set(parts)
        return None
    return None


@lru_cache(maxsize=None)
def ahead(pattern: str) -> str:
    """For a pattern that begins at a word boundary, a look at the next character: far cheaper than the boundary; else empty.

    All alternatives have to begin so: one that doesn't is no sequence with a boundary in front.
    """
    if parser is None or not pattern.startswith(r"\b"):
        return ""
    try:
        tree = list(parser.parse(pattern))
    except (re.error, OverflowError):
        return ""
    first = _firsts(tree[1:]) if tree and tree[0] == (c.AT, c.AT_BOUNDARY) else None
    return "(?=[" + "".join(sorted(first)) + "])" if first else ""


@lru_cache(maxsize=None)
def required(pattern: str, flags: str = "") -> tuple[bool, tuple[str, ...]]:
    """(ignore case, literals) of a pattern; none when it cannot be told."""
    if parser is None:
        return False, ()
    try:
        tree = parser.parse(pattern)
    except (re.error, OverflowError):
        return False, ()
    fold = "i" in flags or bool(tree.state.flags & re.IGNORECASE)
    found = {run.lower() if fold else run for run in _runs(tree)}
    # Letters with case partners outside ASCII make a folded guard unsafe.
    found = {run for run in found if run.isascii()}
    longest = sorted(found, key=lambda run: (-len(run), run))
    return fold, tuple(longest[:MAX_GUARDS])
