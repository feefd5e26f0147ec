"""Exact dedup: two-pass Bloom filtering finds possibly repeated hashes; only those rows shuffle.

Pass one sets, for each row, K bits of a filter that tells "hit once" from "hit twice or more"; tasks make partial
filters, and chunks of these are merged on the executors. Pass two tests each row against the "twice" bits. Rows that
fail the test are certainly alone and pass straight through; the others are grouped exactly by SHA-256, so a false
positive costs a small shuffled row and never a wrong answer.

The filter has 8 bits per row between MIN_BITS and MAX_BITS; the upper bound (a parameter) is what makes the broadcast
safe. Beyond it more rows take the exact way, whose shuffled rows hold a digest and an id, never a text.

Null text counts as empty. Equal texts are one group, whatever their other columns. Of rows that repeat both the
largest doc_id and the text, all are `kept` in the decisions, and one stays in `deduplicate`. A null doc_id is smaller
than any other. An empty table gives an empty result.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.llm.common import apart, ascii_lower, settle, ship

K, MIN_BITS, MAX_BITS, CHUNK = 3, 1 << 16, 1 << 28, 1 << 16


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """K places of each hash (double hashing)."""
    h = hashes.view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(low + np.uint64(i) * high) & np.uint64(bits - 1) for i in range(K)])


def _partial(bits: int):
    """One task's rows -> its non-empty chunks of the bits hit once and hit again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            spots, n = np.unique(positions(batch.column(0).to_numpy(zero_copy_only=False), bits).ravel(), return_counts=True)
            at, mask = spots >> np.uint64(3), (np.uint64(1) << (spots & np.uint64(7))).astype(np.uint8)
            repeated = (n > 1) | ((once[at] & mask) > 0)
            np.bitwise_or.at(again, at[repeated], mask[repeated])
            np.bitwise_or.at(once, at, mask)
        yield from _chunks({i: (a, b) for i, (a, b) in enumerate(zip(_rows(once), _rows(again))) if a.any()})
    return run


def _rows(data: np.ndarray) -> np.ndarray:
    return data.reshape(-1, min(CHUNK // 8, len(data)))


def _chunks(parts: dict) -> Iterator[pa.RecordBatch]:
    for i, (a, b) in parts.items():
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([i], pa.int32()), "once": pa.array([a.tobytes()], pa.binary()), "again": pa.array([b.tobytes()], pa.binary())})


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of partial filters, one at a time: bits hit again anywhere, or once in two places."""
    parts: dict = {}
    for batch in batches:
        for i, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
            if i in parts:
                a, b = parts[i][0] | a, parts[i][1] | b | (parts[i][0] & a)
            parts[i] = (a, b)
    yield from _chunks(parts)


def repeat_filter(hashes: DataFrame, rows: int, max_bits: int = MAX_BITS) -> np.ndarray:
    """The "hit twice or more" bits of a one-column frame of hashes; at most max_bits."""
    bits = min(max_bits, max(MIN_BITS, 1 << (8 * rows - 1).bit_length() if rows else 0))
    schema = "chunk int, once binary, again binary"
    merged = hashes.mapInArrow(_partial(bits), schema).repartition("chunk").mapInArrow(_merge, schema)
    out = np.zeros(bits // 8, np.uint8)
    for row in merged.select("chunk", "again").collect():
        _rows(out)[row["chunk"]] = np.frombuffer(row["again"], np.uint8)
    return out


def maybe_repeated(spark: SparkSession, bits: np.ndarray, column: Column) -> Column:
    """Whether a hash may occur twice; never false for one that does."""
    shared = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def test(hashes: pd.Series) -> pd.Series:
        table = shared.value
        spots = positions(hashes.to_numpy(dtype=np.int64), len(table) * 8)
        return pd.Series(((table[spots >> np.uint64(3)] >> (spots & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0))
    return test(column)


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256))


def _groups(rows: DataFrame) -> DataFrame:
    """Stored, so that a join with them has an exchange on both sides and Spark can split the rows of a large group."""
    return settle(rows.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "op1-groups")


def decisions(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    spark = docs.sparkSession
    prints = apart(docs).select("doc_id", digest(F.col("text")).alias("sha"))
    prints = settle(prints.withColumn("h", F.xxhash64("sha")), "op1-prints")
    bits = repeat_filter(prints.select("h"), prints.count(), max_bits)
    tested = prints.withColumn("maybe", maybe_repeated(spark, bits, F.col("h")))
    alone = tested.where(~F.col("maybe")).select("doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    rows = tested.where("maybe").select("doc_id", "sha")
    found = rows.join(_groups(rows), "sha").select("doc_id", "sha", "keep_id", "group_size")
    return alone.unionByName(found).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicate(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows that stay, with their own columns: those surely alone never shuffle."""
    spark, names = docs.sparkSession, docs.columns
    prints = settle(docs.select(F.col("doc_id").alias("doc_id"), digest(F.col("text")).alias("sha")).withColumn("h", F.xxhash64("sha")), "op1-prints")
    bits = repeat_filter(prints.select("h"), prints.count(), max_bits)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), digest(F.col("text")).alias("sha"))
    tested = whole.withColumn("maybe", maybe_repeated(spark, bits, F.xxhash64("sha")))
    groups = _groups(prints.where(maybe_repeated(spark, bits, F.col("h")))).withColumnRenamed("sha", "group_sha")
    stay = (tested.where("maybe").join(groups, (F.col("sha") == F.col("group_sha")) & F.col("row.doc_id").eqNullSafe(F.col("keep_id")))
            .withColumn("id", F.col("row.doc_id")).dropDuplicates(["sha", "id"]))
    return tested.where(~F.col("maybe")).select("row.*").unionByName(stay.select("row.*"))


ship(__name__)
