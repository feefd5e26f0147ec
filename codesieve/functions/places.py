"""First places of names in a long line; a helper for tasks, sent to executors by value."""

from __future__ import annotations

import re
import sys
from collections import defaultdict

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType

NUMBERED_NAME = re.compile("([a-z]+)([0-9]+)")
WHOLE_NAME = re.compile(NUMBERED_NAME.pattern + r"\Z")


def places_of(text: str, names: list[str]) -> list[int]:
    """For each name, the index of its first place in the text (-1: none), inside longer words as well.

    A numbered name lies within one run of letters followed by digits, as an end of the letters and a start of the
    digits, so the runs are read once. Other names are searched for one by one: rules list few of them.
    """
    first: dict[str, int] = {}
    endings: dict[str, dict[int, set[str]]] = defaultdict(lambda: defaultdict(set))
    for name in set(names):
        parts = WHOLE_NAME.match(name)
        if parts:
            endings[parts[1]][len(parts[2])].add(parts[2])
        else:
            first[name] = text.find(name)
    sizes = sorted({len(e) for e in endings})
    seen: set[tuple[str, str]] = set()
    for run in NUMBERED_NAME.finditer(text) if endings else ():
        letters, digits = run.groups()
        if (letters, digits) in seen:
            continue
        seen.add((letters, digits))
        for size in sizes:
            if size > len(letters):
                break
            ending = letters[len(letters) - size:]
            for width, known in endings.get(ending, {}).items():
                if digits[:width] in known:
                    first.setdefault(ending + digits[:width], run.end(1) - size)
    return [first.get(name, -1) for name in names]


@arrow_udf(ArrayType(IntegerType()))
def first_places(texts: pa.Array, names: pa.Array) -> pa.Array:
    return pa.array([None if t is None or n is None else places_of(t, n) for t, n in zip(texts.to_pylist(), names.to_pylist())],
                    pa.list_(pa.int32()))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
