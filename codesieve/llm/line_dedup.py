"""Line dedup: sharded cuckoo filters before exact reference-count tables; insertions and deletions are reversible.

A line's key is the line without blanks at its ends and with A-Z lowered; keys under MIN_CHARS code points are never
dropped. The state holds three tables: `postings` (key, doc_id), `refs` (key, number of documents, largest doc_id) and
`filters` (one row per shard of keys: a cuckoo table of 32-bit fingerprints, one fingerprint per key in refs).

Inserting asks the shard's filter about each key of the batch, counted beforehand, so that a line of very many documents
is one row. A key that the filter doesn't know is new for certain and is appended without a look at refs; the others are
joined with refs, which corrects a false alarm. Where refs and the batch outgrow SHARD_KEYS keys a shard, the filters are
first rebuilt from refs with more shards. Deleting lowers the counts of a document's keys; a key that falls to none
leaves refs and the filter. The decision is exact: a key in at least MIN_DOCS documents stays in the largest of them.

Null or empty text is one empty line. Equal lines of a document count once and are dropped together. Rows that repeat a
doc_id are one document to the counts, and each is cleaned. A null doc_id is smaller than any other.
Texts of any length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.llm.common import settle, ship

MIN_CHARS, MIN_DOCS, SHARD_KEYS, MIN_SHARDS = 20, 3, 400_000, 8
SLOTS, KICKS, FIRST_BUCKETS, MOST_BUCKETS = 4, 200, 1 << 12, 1 << 20
BLANKS = " \t\n\x0b\x0c\r"
KEY = ["k1", "k2"]
MASK = (1 << 64) - 1


def line_key(line: str) -> bytes | None:
    """16 bytes that stand for a line's key; None for a short one."""
    line = line.strip(BLANKS)
    return hashlib.blake2b(line.encode("utf-8", "replace").lower(), digest_size=16).digest() if len(line) >= MIN_CHARS else None


class CuckooFilter:
    """One cuckoo table of 32-bit values, made anew at twice the size when it is full.

    A value tells both of its buckets in a table of any size, so growing moves every value with it, and removing takes out
    a value that was put in for this key or for one that no table can tell from it. So a key that was added and not removed
    is always found.
    """

    def __init__(self, data: bytes | None = None):
        self.table = array("I", data or bytes(4 * SLOTS * FIRST_BUCKETS))

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @staticmethod
    def _value(key: tuple[int, int]) -> int:
        return key[1] & 0xFFFFFFFF or 1

    @staticmethod
    def _buckets(value: int, mask: int) -> tuple[int, int]:
        first = (value >> 12) & mask
        return first, first ^ ((value * 0x9E3779B1 >> 7 & mask) | 1) & mask

    def _spots(self, value: int) -> list[int]:
        return [b * SLOTS + i for b in self._buckets(value, len(self.table) // SLOTS - 1) for i in range(SLOTS)]

    def __contains__(self, key: tuple[int, int]) -> bool:
        value, table = self._value(key), self.table
        a, b = self._buckets(value, len(table) // SLOTS - 1)
        return value in table[a * SLOTS:a * SLOTS + SLOTS] or value in table[b * SLOTS:b * SLOTS + SLOTS]

    def add(self, key: tuple[int, int]) -> None:
        self._put(self._value(key))

    def _put(self, value: int) -> None:
        moved, table = value, self.table
        mask = len(table) // SLOTS - 1
        for n in range(KICKS):
            for spot in self._spots(moved):
                if not table[spot]:
                    table[spot] = moved
                    return
            bucket = self._buckets(moved, mask)[n & 1]
            spot = bucket * SLOTS + (moved + n) % SLOTS
            moved, table[spot] = table[spot], moved
        self._grow(moved)

    def _grow(self, homeless: int) -> None:
        if len(self.table) // SLOTS >= MOST_BUCKETS:
            raise ValueError("a shard's filter can't grow further; use more shards")
        values = [v for v in self.table if v]
        self.table = array("I", bytes(8 * len(self.table)))
        for value in [*values, homeless]:
            self._put(value)

    def remove(self, key: tuple[int, int]) -> bool:
        """Take out one value of a key that was added."""
        value = self._value(key)
        for spot in self._spots(value):
            if self.table[spot] == value:
                self.table[spot] = 0
                return True
        return False


@dataclass
class LineState:
    postings: DataFrame
    refs: DataFrame
    filters: DataFrame
    shards: int


def empty(spark: SparkSession, shards: int = 0) -> LineState:
    """No documents; with shards 0 the first insertion chooses their number, one for SHARD_KEYS postings."""
    make = lambda schema: spark.createDataFrame([], schema)
    return LineState(make("k1 long, k2 long, doc_id long"), make("k1 long, k2 long, refs long, max_doc long"), make("shard long, data binary"), shards)


def _postings(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = {k for k in map(line_key, (text or "").split("\n")) if k}
                ids += [doc_id] * len(found)
                keys += found
            pair = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(ids, pa.int64())], ["k1", "k2", "doc_id"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "k1 long, k2 long, doc_id long")


def _counts(postings: DataFrame) -> DataFrame:
    """Documents by key; a document counts once."""
    return postings.groupBy("k1", "k2", "doc_id").agg(F.lit(1).alias("one")).groupBy(*KEY).agg(F.sum("one").alias("refs"), F.max("doc_id").alias("max_doc"))


def _pairs(rows: pd.DataFrame) -> list[tuple[int, int]]:
    return list(zip((rows["k1"].to_numpy(np.int64).view(np.uint64)).tolist(), (rows["k2"].to_numpy(np.int64).view(np.uint64)).tolist()))


def _sharded(keys: DataFrame, filters: DataFrame, shards: int, step) -> DataFrame:
    """Run step(filter, keys) -> known by shard; rows (shard, k1, k2, known, data), the filter in a row of its own."""
    def run(key: tuple, rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        cuckoo = CuckooFilter(held["data"].iloc[0] if len(held) else None)
        known = step(cuckoo, _pairs(rows))
        out = pd.DataFrame({"shard": key[0], "k1": rows["k1"], "k2": rows["k2"], "known": known, "data": None})
        return pd.concat([out, pd.DataFrame([{"shard": key[0], "k1": None, "k2": None, "known": False, "data": cuckoo.to_bytes()}])]).astype({"k1": "Int64", "k2": "Int64"})
    left = keys.withColumn("shard", F.pmod("k1", F.lit(shards))).groupBy("shard")
    return settle(left.cogroup(filters.groupBy("shard")).applyInPandas(run, "shard long, k1 long, k2 long, known boolean, data binary"), "op9-shards")


def _ask_and_add(cuckoo: CuckooFilter, keys: list[tuple[int, int]]) -> list[bool]:
    known = [k in cuckoo for k in keys]
    for key, met in zip(keys, known):
        if not met:
            cuckoo.add(key)
    return known


def _add_all(cuckoo: CuckooFilter, keys: list[tuple[int, int]]) -> list[bool]:
    for key in keys:
        cuckoo.add(key)
    return [False] * len(keys)


def _remove_all(cuckoo: CuckooFilter, keys: list[tuple[int, int]]) -> list[bool]:
    return [cuckoo.remove(k) for k in keys]


def insert(state: LineState, docs: DataFrame) -> LineState:
    """The state with these documents as well; a document that it holds already adds nothing for the lines it had."""
    fresh = _postings(docs)
    if state.shards:
        fresh = _without(fresh, state.postings)
    fresh = settle(fresh, "op9-postings")
    shards = state.shards or max(MIN_SHARDS, -(-fresh.count() // SHARD_KEYS))
    batch = settle(_counts(fresh), "op9-counts")
    filters = state.filters
    if state.shards:
        need = -(-(state.refs.count() + batch.count()) // SHARD_KEYS)
        if need > shards:
            shards, filters = resharded(state, max(need, 2 * shards))
    asked = _sharded(batch.select(*KEY), filters, shards, _ask_and_add)
    known = asked.where("known").select(*KEY)
    # A key that the filter took for a known one, but refs doesn't hold, has no fingerprint of its own yet.
    new = batch.join(asked.where("k1 is not null and not known").select(*KEY), KEY)
    met = batch.join(known, KEY).join(state.refs.select(*KEY, F.col("refs").alias("old"), F.col("max_doc").alias("old_doc")), KEY, "left")
    met = settle(met, "op9-met")
    late = met.where("old is null").select(*KEY)
    filters = _latest(filters, asked)
    if not late.isEmpty():
        filters = _latest(filters, _sharded(late, filters, shards, _add_all))
    merged = met.select(*KEY, (F.col("refs") + F.coalesce("old", F.lit(0))).alias("refs"), F.greatest("max_doc", "old_doc").alias("max_doc"))
    refs = state.refs.join(known, KEY, "left_anti").unionByName(new).unionByName(merged)
    return LineState(state.postings.unionByName(fresh), settle(refs, "op9-refs"), settle(filters, "op9-filters"), shards)


def resharded(state: LineState, shards: int) -> tuple[int, DataFrame]:
    """So many shards, and filters for them with the keys of refs."""
    return shards, _latest(state.filters.limit(0), _sharded(state.refs.select(*KEY), state.filters.limit(0), shards, _add_all))


def _without(rows: DataFrame, held: DataFrame) -> DataFrame:
    held = held.select(F.col("k1").alias("h1"), F.col("k2").alias("h2"), F.col("doc_id").alias("held_doc"))
    return rows.join(held, (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")) & F.col("doc_id").eqNullSafe(F.col("held_doc")), "left_anti")


def _latest(filters: DataFrame, stepped: DataFrame) -> DataFrame:
    now = stepped.where("data is not null").select("shard", "data")
    return filters.join(now.select("shard"), "shard", "left_anti").unionByName(now)


def delete(state: LineState, doc_ids: DataFrame) -> LineState:
    """The state without the documents of the column doc_id, as if they had never been inserted."""
    gone = doc_ids.select(F.col("doc_id").alias("gone_id")).distinct()
    match = F.col("doc_id").eqNullSafe(F.col("gone_id"))
    left = settle(state.postings.join(gone, match, "left_anti"), "op9-postings")
    touched = settle(state.postings.join(gone, match, "left_semi").select(*KEY).distinct(), "op9-touched")
    now = settle(touched.join(_counts(left.join(touched, KEY, "left_semi")), KEY, "left"), "op9-now")
    stepped = _sharded(now.where("refs is null").select(*KEY), state.filters, state.shards, _remove_all)
    refs = state.refs.join(touched, KEY, "left_anti").unionByName(now.where("refs is not null"))
    return LineState(left, settle(refs, "op9-refs"), settle(_latest(state.filters, stepped), "op9-filters"), state.shards)


def clean(state: LineState, docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, cleaned (the lines that stay) for every row of docs, by the state's counts."""
    common = state.refs.where(F.col("refs") >= min_docs)
    drops = state.postings.join(common, KEY).where(~F.col("doc_id").eqNullSafe(F.col("max_doc")))
    # One document's keys at most come together here.
    lists = drops.groupBy("doc_id").agg(F.collect_set(F.struct(*KEY)).alias("keys")).select(F.col("doc_id").alias("drop_id"), "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for text, keys in zip(batch.column("text").to_pylist(), batch.column("keys").to_pylist()):
                lines = (text or "").split("\n")
                drop = {np.array([k["k1"], k["k2"]], "<i8").tobytes() for k in keys or ()}
                stay = [x for x in lines if line_key(x) not in drop] if drop else lines
                for column, value in zip(out, (len(lines), len(lines) - len(stay), "\n".join(stay))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["doc_id", "n_lines", "n_dropped", "cleaned"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.join(lists, F.col("doc_id").eqNullSafe(F.col("drop_id")), "left").select("doc_id", "text", "keys").mapInArrow(
        run, "doc_id long, n_lines long, n_dropped long, cleaned string")


def decisions(docs: DataFrame, batches: int = 2) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256: the rows inserted in batches, dealt by their doc_id, then cleaned.

    From the second batch on the filters say which keys are new; the others are added up with the exact counts.
    """
    state = empty(docs.sparkSession)
    for k in range(batches):
        state = insert(state, docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k))
    return clean(state, docs).select("doc_id", "n_lines", "n_dropped", F.sha2("cleaned", 256).alias("kept_sha256"))


ship(__name__)
