"""Benchmark decontamination: a broadcast hash set of test n-grams against every window of the training texts.

Words are runs of letters, digits and characters beyond ASCII, with A-Z lowered. A window is WINDOW consecutive words of
an item; an item of fewer words is one window, one without words is none. Items become an index: numbered words, the
distinct windows as rows of numbers, their hashes in order, and the items that hold each. Each task numbers the words of
its texts by that index, hashes windows of known words only, looks them up and verifies a hit word by word. What is hit
is marked for removal as spans, or the whole document goes.

The index is broadcast in parts of at most PART_CHARS characters of item text, whose sum is taken beforehand: one part
for any usual benchmark; with more, the documents are scanned once for each part and the findings of a row are put
together. Items longer than SEGMENT words are cut into overlapping segments that hold the same windows.

Null or empty text has no words. A repeated doc_id is judged row by row, a null one too. Texts of any length are read
whole. Equal items are one; an item_id with several texts has the windows of all of them; an item without an id hits words
but is neither listed nor counted. Without items nothing is hit; without documents there are no rows. Other columns of
either table are not looked at, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import repeat
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import settle, ship

WINDOW, PART_CHARS, SEGMENT = 10, 1 << 25, 100_000
#: Bytes of words: digits, letters (A-Z lowered) and all beyond ASCII; any other byte is a blank.
PLAIN = bytes(b if b > 127 or chr(b).isdigit() or "a" <= chr(b) <= "z" else b + 32 if "A" <= chr(b) <= "Z" else 32 for b in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
FOUND = "row_no long, doc_id long, n_words long, first array<int>, last array<int>, item_ids array<string>"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(PLAIN).split()


@dataclass
class Windows:
    """Distinct windows of one length: hashes in order, the words of each, and its items from starts[i] to starts[i + 1]."""
    factors: np.ndarray
    keys: np.ndarray
    words: np.ndarray
    starts: np.ndarray
    items: np.ndarray


class Index:
    """Windows of items, by their length."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items if name is not None})
        place = {name: i for i, name in enumerate(self.names)} | {None: -1}
        held: dict[int, dict[tuple, set]] = {}
        for name, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers)) for w in words_of(text)]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                held.setdefault(size, {}).setdefault(tuple(ids[i:i + size]), set()).add(place[name])
        self.tables = [self._table(size, windows) for size, windows in sorted(held.items())]

    @staticmethod
    def _table(size: int, windows: dict[tuple, set]) -> Windows:
        words = np.array(list(windows), np.int64)
        for seed in range(64):
            factors = np.random.default_rng(seed).integers(1, 1 << 63, size, np.uint64) | np.uint64(1)
            keys = (words.astype(np.uint64) * factors).sum(axis=1)
            order = np.argsort(keys)
            keys = keys[order]
            if (keys[1:] != keys[:-1]).all():
                break
        else:
            raise ValueError("no factors tell the windows apart")
        lists = list(windows.values())
        lists = [sorted(lists[i]) for i in order]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        return Windows(factors, keys, words[order], starts, np.array([i for x in lists for i in x], np.int64))

    def find(self, words: list[bytes]) -> tuple[np.ndarray, list[str]]:
        """Which words are hit, and the names of the items with occurring windows, in order."""
        ids = np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int64, len(words))
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        change, found = np.zeros(len(words) + 1, np.int64), set()
        for t in self.tables:
            size = len(t.factors)
            at = np.flatnonzero(known[size:] - known[:-size] == size) if len(words) >= size else np.array([], np.int64)
            if not len(at):
                continue
            keys = np.zeros(len(at), np.uint64)
            for k, factor in enumerate(t.factors):
                keys += ids[at + k].astype(np.uint64) * factor
            spot = np.minimum(np.searchsorted(t.keys, keys), len(t.keys) - 1)
            same = t.keys[spot] == keys
            at, spot = at[same], spot[same]
            real = (ids[at[:, None] + np.arange(size)] == t.words[spot]).all(axis=1)
            at, spot = at[real], spot[real]
            np.add.at(change, at, 1)
            np.add.at(change, at + size, -1)
            for w in np.unique(spot).tolist():
                found.update(t.items[t.starts[w]:t.starts[w + 1]].tolist())
        return np.cumsum(change[:-1]) > 0, [self.names[i] for i in sorted(found - {-1})]


def spans(hit: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last place of each run of hit words."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()


def _indexes(items: DataFrame, window: int, part_chars: int) -> list[Index]:
    """The items' index, in parts of about part_chars characters."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = items.select(F.col("item_id").cast("string").alias("name"), text.alias("text"))
    total = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    if total <= part_chars:
        return [Index([(r["name"], r["text"].encode()) for r in rows.collect()], window)]
    words = F.split(F.trim(F.regexp_replace("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")), " ")
    step = SEGMENT - window + 1
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - window), F.lit(step))
    cut = rows.select("name", words.alias("words")).select("name", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i + 1, SEGMENT), " "))).alias("text"))
    parts = -(-2 * total // part_chars)
    cut = settle(cut.withColumn("part", F.pmod(F.xxhash64("name", "text"), F.lit(parts))), "op11-items")
    # One part at a time reaches the driver.
    return [Index([(r["name"], r["text"].encode()) for r in cut.where(F.col("part") == p).collect()], window) for p in range(parts)]


def _findings(docs: DataFrame, index: Index) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text in batch.column("text").cast(pa.binary()):
                words = words_of(text.as_py())
                hit, names = index.find(words)
                for column, value in zip(out, (len(words), *(spans(hit) if hit.any() else ([], [])), names)):
                    column.append(value)
            types = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("row_no"), batch.column("doc_id"), *map(pa.array, out, types)],
                                             ["row_no", "doc_id", "n_words", "first", "last", "item_ids"])
    return docs.mapInArrow(run, FOUND)


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, part_chars: int = PART_CHARS) -> DataFrame:
    """doc_id, n_words, first, last (word places of each hit span, from 0), item_ids (of occurring windows, as strings in order)."""
    rows = docs.select(F.lit(0).cast("long").alias("row_no"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    indexes = _indexes(items, window, part_chars)
    if len(indexes) == 1:
        return _findings(rows, indexes[0]).drop("row_no")
    rows = settle(rows.withColumn("row_no", F.monotonically_increasing_id()), "op11-rows")
    parts = [settle(_findings(rows, index), "op11-found") for index in indexes]
    every = parts[0]
    for more in parts[1:]:
        # A row has one finding for each part, so a group is as small as the number of parts.
        every = every.unionByName(more)
    grouped = every.groupBy("row_no").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
                                          F.flatten(F.collect_list(F.arrays_zip("first", "last"))).alias("both"),
                                          F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, last = [], []
            for n, both in zip(batch.column("n_words").to_pylist(), batch.column("both").to_pylist()):
                change = np.zeros(n + 1, np.int64)
                for b in both:
                    change[b["first"]] += 1
                    change[b["last"] + 1] -= 1
                a, z = spans(np.cumsum(change[:-1]) > 0)
                first.append(a)
                last.append(z)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(first, pa.list_(pa.int32())), pa.array(last, pa.list_(pa.int32())), batch.column("item_ids")],
                                             ["doc_id", "n_words", "first", "last", "item_ids"])
    return grouped.mapInArrow(union, FOUND.replace("row_no long, ", ""))


def without_spans(text: bytes, hit: np.ndarray) -> bytes:
    """A text without its hit words and what stands between them."""
    at = [m.span() for m in WORD.finditer(text)]
    out, done = [], 0
    for a, z in zip(*spans(hit)):
        out.append(text[done:at[a][0]])
        done = at[z][1]
    return b"".join([*out, text[done:]])


def clean(docs: DataFrame, items: DataFrame, whole: bool = False, window: int = WINDOW, part_chars: int = PART_CHARS) -> DataFrame:
    """The documents without the hit spans or, with `whole`, without the documents that have any; all columns stay.

    What is cut brings no new windows of later parts to light: all parts look at the text as it came.
    """
    indexes = _indexes(items, window, part_chars)
    shared = [docs.sparkSession.sparkContext.broadcast(i) for i in indexes]
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, stay = batch.column(place).cast(pa.binary()).to_pylist(), []
            for i, text in enumerate(texts):
                words = words_of(text)
                hit = np.zeros(len(words), bool)
                for index in shared:
                    hit |= index.value.find(words)[0]
                stay.append(not (whole and hit.any()))
                if hit.any() and not whole:
                    texts[i] = without_spans(text, hit)
            column = pa.array(texts, pa.binary()).view(pa.string())
            yield pa.RecordBatch.from_arrays([column if i == place else c for i, c in enumerate(batch.columns)], batch.schema.names).filter(pa.array(stay, pa.bool_()))
    return docs.mapInArrow(run, docs.schema)


def decisions(docs: DataFrame, items: DataFrame, window: int = WINDOW, part_chars: int = PART_CHARS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row."""
    length = lambda a, b: (F.coalesce(F.aggregate(F.zip_with(b, a, lambda z, y: z - y + 1), F.lit(0).cast("long"), lambda s, n: s + n), F.lit(0))).cast("long")
    found = scan(docs, items, window, part_chars)
    return found.select("doc_id", "n_words", length("first", "last").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.size("first") > 0).alias("contaminated"))


ship(__name__)
