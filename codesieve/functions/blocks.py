"""Repeated and similar blocks of one file's lines; a helper for tasks, sent to executors by value."""

from __future__ import annotations

import math
import sys
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import merge

from pyspark import cloudpickle

WINDOW_LINES = 4
MIN_SIMILARITY = 0.8


def _numbered(norm: list[str]) -> tuple[list[int], dict[str, int]]:
    """The lines as numbers, and each different line's number."""
    known: dict[str, int] = {}
    return [known.setdefault(line, len(known)) for line in norm], known


def word_sets(norm: list[str], window: int, least: float = 0.0) -> list[tuple[int, ...]]:
    """The words of each window of lines as numbers in ascending order, words of few lines first.

    Equal lines are cut once, and equal windows share one tuple. With ``least``, windows that can't have this similarity with
    one of other lines stay empty: too many of their words stand on no other line.
    """
    lines, known = _numbered(norm)
    words = [set(line.split(" ")) for line in known]
    often: Counter = Counter()
    for line, times in Counter(lines).items():
        often.update(words[line])
        if times > 1:
            for w in words[line]:
                often[w] += times - 1
    once = {w for w, n in often.items() if n == 1}
    # Words on other lines as well, less the least share of all words: a window of lines that sum up below zero is hopeless.
    surplus = [len(w) * (1 - least) - len(w & once) for w in words]
    spare = [surplus[line] for line in lines]
    number: dict[str, int] = {}
    made: dict[tuple[int, ...], tuple[int, ...]] = {}
    blocks = []
    for i, hope in enumerate(map(sum, zip(*(spare[k:] for k in range(window))))):
        if least and hope < -1e-6:
            blocks.append(())
            continue
        key = tuple(lines[i:i + window])
        if key not in made:
            number = number or {w: k for k, w in enumerate(sorted(often, key=lambda w: (often[w], w)))}
            made[key] = tuple(sorted(map(number.__getitem__, set().union(*map(words.__getitem__, key)))))
        blocks.append(made[key])
    return blocks


def next_similar(blocks: list[tuple[int, ...]], window: int, least: float) -> Iterator[tuple[int, int, float]]:
    """For each block, the first one at least ``window`` later with this similarity of word sets, where there is one.

    Two such sets share one of the first ``size - ceil(least * size) + 1`` words of a common order. The places of these words
    are walked in step from the block onwards, each different set is judged once, and the walk ends at the first that fits;
    no list of pairs is held.
    """
    sets: dict[tuple[int, ...], int] = {}
    kinds = [sets.setdefault(b, len(sets)) for b in blocks]
    prefix = lambda b: b[:len(b) - math.ceil(len(b) * least - 1e-9) + 1]
    places: dict[int, list[int]] = defaultdict(list)
    for i, block in enumerate(blocks):
        for w in prefix(block):
            places[w].append(i)
    for i, block in enumerate(blocks):
        # Most words of the prefix have no place so far on.
        later = [p for p in map(places.__getitem__, prefix(block)) if p[-1] >= i + window]
        if not later:
            continue
        words, judged = frozenset(block), set()
        for other in merge(*[map(p.__getitem__, range(bisect_left(p, i + window), len(p))) for p in later]):
            if kinds[other] in judged:
                continue
            judged.add(kinds[other])
            sizes = sorted((len(block), len(blocks[other])))
            if sizes[0] >= sizes[1] * least:
                shared = len(words.intersection(blocks[other]))
                similarity = shared / (sum(sizes) - shared)
                if similarity >= least:
                    yield i, other, similarity
                    break


def each_repeat(norm: list[str], window: int = WINDOW_LINES, least: float = MIN_SIMILARITY) -> Iterator[tuple[int, int, float]]:
    """(start, later start, similarity) from 0: exact repeats of a first block, then each block's next similar one.

    The last block takes no part in the search for similar ones. Each is found when it is asked for, so a caller that wants
    the first few does not pay for the others.
    """
    first: dict[tuple, int] = {}
    lines, _ = _numbered(norm)
    for i, block in enumerate(zip(*(lines[k:] for k in range(window)))):
        start = first.setdefault(block, i)
        if start < i:
            yield start, i, 1.0
    yield from next_similar(word_sets(norm, window, least)[:-1], window, least)


def repeated_blocks(norm: list[str], window: int = WINDOW_LINES, least: float = MIN_SIMILARITY) -> list[tuple[int, int, float]]:
    """All of ``each_repeat``."""
    return list(each_repeat(norm, window, least))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
