"""Counts over the tokens of texts; helpers for tasks, sent to executors by value.

Each takes a batch of token arrays and numbers its different tokens once, so no text is made or compared per token. Batches
are cut into parts of PART tokens, which bounds what a task holds besides its input; a longer row is a part of its own.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from codesieve.rulebook.grammar import HALSTEAD_OPERATORS
from codesieve.rulebook.style import ENTROPY_STOP_TOKENS

#: Tokens counted at a time: few enough for a processor's cache, and for a row and two tokens to fit into one 64-bit number.
PART = 1 << 16
OPERATORS, STOPPED = pa.array(HALSTEAD_OPERATORS), pa.array(ENTROPY_STOP_TOKENS)


def _parts(tokens: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """``(first row and rows after the last one, row of each token from 0, number of each token, different tokens)`` of the parts."""
    sizes = np.asarray(tokens.value_lengths().fill_null(0), dtype=np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    flat = tokens.flatten()
    start = 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + PART, side="right")) - 1)
        coded = flat.slice(ends[start], ends[stop] - ends[start]).dictionary_encode()
        rows = np.repeat(np.arange(stop - start, dtype=np.int64), sizes[start:stop])
        yield np.array([start, stop]), rows, np.asarray(coded.indices, dtype=np.int64), coded.dictionary
        start = stop


def _different(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and how often each occurs."""
    keys = np.sort(keys)
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[starts], np.diff(starts, append=len(keys))


def _struct(tokens: pa.Array, columns: dict[str, pa.Array]) -> pa.Array:
    """One struct a row, null where the row is."""
    return pa.StructArray.from_arrays(list(columns.values()), list(columns), mask=tokens.is_null())


def _ints(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.int32))


def gram_counts(tokens: pa.Array) -> pa.Array:
    """``(u2, u3)``: different pairs and triples of neighbouring tokens of each row."""
    u2, u3 = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.int64)
    for (start, stop), rows, codes, words in _parts(tokens):
        n, total = int(stop - start), max(1, len(words))
        near = rows[:-1] == rows[1:]
        whole = near[:-1] & near[1:]
        pair = (rows[:-1] * total + codes[:-1]) * total + codes[1:]
        pairs, _ = _different(pair[near])
        u2[start:stop] = np.bincount(pairs // (total * total), minlength=n)
        # Where a row and three tokens don't fit into one number, the pair's place among the pairs stands for row and pair.
        fits = n * total ** 3 < 1 << 63
        triples, _ = _different((pair if fits else np.searchsorted(pairs, pair))[:-1][whole] * total + codes[2:][whole])
        of = triples // total if fits else pairs[triples // total]
        u3[start:stop] = np.bincount(of // (total * total), minlength=n)
    return _struct(tokens, {"u2": _ints(u2), "u3": _ints(u3)})


def operator_counts(tokens: pa.Array) -> pa.Array:
    """``(n1, n2, big_n1, big_n2)``: different operators and operands of each row, and all of them."""
    out = {name: np.zeros(len(tokens), np.int64) for name in ("n1", "n2", "big_n1", "big_n2")}
    for (start, stop), rows, codes, words in _parts(tokens):
        n, total = int(stop - start), max(1, len(words))
        operator, letter = pc.is_in(words, value_set=OPERATORS), pc.match_substring_regex(words, "^[A-Za-z_]")
        kinds = np.where(operator.to_numpy(False), 1, np.where(letter.to_numpy(False), 2, 0)).astype(np.int8)
        kind = kinds[codes]
        different, _ = _different((rows * total + codes)[kind > 0])
        for k in (1, 2):
            out[f"big_n{k}"][start:stop] = np.bincount(rows[kind == k], minlength=n)
            out[f"n{k}"][start:stop] = np.bincount(different[kinds[different % total] == k] // total, minlength=n)
    return _struct(tokens, {name: _ints(c) for name, c in out.items()})


def identifier_counts(tokens: pa.Array) -> pa.Array:
    """``(n, names, counts)``: the tokens that entropy counts, the different ones in order, joined by spaces, and how often each occurs."""
    n, names, counts, sizes = np.zeros(len(tokens), np.int64), [], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
    for (start, stop), rows, codes, words in _parts(tokens):
        order = np.asarray(pc.array_sort_indices(words), dtype=np.int64)
        words, total = words.take(order), max(1, len(words))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        counted = ~pc.is_in(words, value_set=STOPPED).to_numpy(False)
        codes = place[codes]
        kept = counted[codes]
        n[start:stop] = np.bincount(rows[kept], minlength=stop - start)
        keys, times = _different((rows * total + codes)[kept])
        sizes.append(np.bincount(keys // total, minlength=stop - start))
        counts.append(times)
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes[-1])]).astype(np.int32))
        names.append(pc.binary_join(pa.ListArray.from_arrays(ends, words.take(keys % total)), " "))
    offsets = pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32))
    return _struct(tokens, {"n": _ints(n), "names": pa.concat_arrays([pa.array([], pa.string()), *names]),
                            "counts": pa.ListArray.from_arrays(offsets, _ints(np.concatenate(counts)))})


def _whole(*names: str) -> StructType:
    return StructType([StructField(name, IntegerType()) for name in names])


count_grams = arrow_udf(gram_counts, _whole("u2", "u3"))
count_operators = arrow_udf(operator_counts, _whole("n1", "n2", "big_n1", "big_n2"))
count_identifiers = arrow_udf(identifier_counts, _whole("n").add("names", StringType()).add("counts", ArrayType(IntegerType())))

cloudpickle.register_pickle_by_value(sys.modules[__name__])
