"""MinHash near-dedup with b-bit signatures: bands propose, low bits estimate, full shingle sets decide.

A document's set holds its distinct WORDS-word shingles. HASHES minima are grouped in BANDS bands, whose equality
proposes pairs (at the threshold a pair is missed with probability (1 - 0.75^4)^32, about five in a million); of each
minimum BITS low bits are kept, packed in long integers. The similarity estimated from equal fields, corrected for
chance collisions, must reach ESTIMATE (more than six standard errors below the threshold); the full sets confirm.

Groups never become all their pairs. Equal sets are one class. In the first round every class meets only the smallest
class of each of its buckets, and confirmed links make components. The second round looks at the buckets that still
hold more than one component: their members come together in blocks of BLOCK (every two blocks of a bucket meet), where
pairs across components are compared by size and packed fields, and what passes is confirmed from the texts on the spot,
once, in the first band that the pair shares. Only links leave a block. Components of both rounds' links are the
result, so no link that joins two components is lost to the first round's choice.

Null texts and texts without words have no shingles, are linked with nothing and stay. A null doc_id is linked with
nothing. A doc_id names one document; rows that repeat it share a component. Ties have no part: the smallest doc_id of
a component stays.
Texts of any length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import apart, settle, ship
from codesieve.llm.components import components

WORDS, PERCENT, HASHES, BANDS, BITS, ESTIMATE, BLOCK = 5, 75, 128, 32, 4, 0.5, 512
FIELDS = HASHES * BITS // 64
STEPS = [1 << k for k in range(BITS.bit_length() - 1)]
#: Lowest bit of each field of a packed long.
ONES = sum(1 << i for i in range(0, 64, BITS))
NEEDED = int(np.ceil(HASHES * (ESTIMATE * (1 - 2.0 ** -BITS) + 2.0 ** -BITS)))


def scrambled(n: int, seed: int) -> np.ndarray:
    """n well-mixed 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Shingle sets of texts as sorted arrays of 64-bit hashes."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.letters = scrambled(256, 1)
        self.order = scrambled(words, 2) | np.uint64(1)
        self.blank = np.zeros(256, bool)
        self.blank[[9, 10, 11, 12, 13, 32]] = True
        self.powers = np.ones(1, np.uint64)

    def word_hashes(self, text: str | None) -> np.ndarray:
        data = np.frombuffer((text or "").encode("utf-8", "replace").lower(), np.uint8)
        blank = self.blank[data]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
        starts, lengths = edge[::2], edge[1::2] - edge[::2]
        if not len(starts):
            return np.zeros(0, np.uint64)
        longest = int(lengths.max())
        if longest > len(self.powers):
            steps = np.full(longest + 1, 0x9E3779B97F4A7C15, np.uint64)
            steps[0] = 1
            self.powers = np.cumprod(steps, dtype=np.uint64)
        place = np.arange(len(data)) - np.repeat(np.append(0, starts), np.diff(np.concatenate(([0], starts, [len(data)]))))
        values = self.letters[data] * self.powers[np.where(blank, 0, place)]
        values[blank] = 0
        return mix(np.add.reduceat(values, starts) + lengths.astype(np.uint64))

    def sets(self, text: str | None) -> np.ndarray:
        w = self.word_hashes(text)
        n = min(len(w), self.words)
        if not n:
            return w
        total = np.full(len(w) - n + 1, n, np.uint64)
        for i in range(n):
            total = total + w[i:len(w) - n + 1 + i] * self.order[i]
        return np.unique(mix(total))


class Signer:
    """Minima, bands and packed low bits of a shingle set."""

    def __init__(self):
        seeds = scrambled(2 * HASHES, 3)
        self.factor = (seeds[:HASHES, None] | np.uint64(1)).astype(np.uint32)
        self.shift = seeds[HASHES:, None].astype(np.uint32)
        self.weights = scrambled(HASHES // BANDS, 4) | np.uint64(1)
        self.names = scrambled(BANDS, 5)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 2048):
            np.minimum(out, (x[at:at + 2048] * self.factor + self.shift).min(axis=1), out=out)
        return mix(out.astype(np.uint64))

    def bands(self, minima: np.ndarray) -> np.ndarray:
        return mix((minima.reshape(BANDS, -1) * self.weights).sum(axis=1, dtype=np.uint64) + self.names)

    def packed(self, minima: np.ndarray) -> np.ndarray:
        low = (minima & np.uint64(2 ** BITS - 1)).reshape(FIELDS, -1)
        return (low << np.arange(0, 64, BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, s1, s2 (a digest of the set), sig, bands; the last two are null where a set is empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(), Signer()
        for batch in batches:
            n, digest, sig, bands = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingler.sets(text)
                n.append(len(s))
                digest.append((s.sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64)))
                minima = signer.minima(s) if len(s) else None
                sig.append(None if minima is None else signer.packed(minima).view(np.int64))
                bands.append(None if minima is None else signer.bands(minima).view(np.int64))
            pair = np.array(digest, np.uint64).reshape(-1, 2).view(np.int64)
            many = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(sig, many), pa.array(bands, many)],
                                             ["doc_id", "n_shingles", "s1", "s2", "sig", "bands"])
    return apart(docs).mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, sig array<long>, bands array<long>")


def similar(a: Column, b: Column) -> Column:
    """Whether enough fields of two packed signatures agree."""
    differing = F.lit(0)
    for i in range(FIELDS):
        x = a[i].bitwiseXOR(b[i])
        for step in STEPS:
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
        differing = differing + F.bit_count(x.bitwiseAND(F.lit(ONES)))
    return differing <= HASHES - NEEDED


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, last, held = Shingler(), None, None
        for batch in batches:
            keep = []
            for a, x, y in zip(batch.column("a").to_pylist(), batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()):
                if a != last:
                    last, held = a, shingler.sets(x)
                other = shingler.sets(y)
                common = len(np.intersect1d(held, other, assume_unique=True))
                keep.append(100 * common >= PERCENT * (len(held) + len(other) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))
    one, two = (texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    return settle(pairs.join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "u long, v long"), "op3-links")


class Block:
    """Members of a bucket, or of two blocks of it; links between different components."""

    def __init__(self, group: pa.Table, shingler: Shingler):
        self.key, self.lo, self.hi = (group.column(c)[0].as_py() for c in ("key", "lo", "hi"))
        self.rep, self.pivot, self.comp, self.own = (group.column(c).to_numpy() for c in ("rep", "pivot", "comp", "own"))
        self.n, self.comp = group.column("n_shingles").to_numpy(), self.comp.copy()
        self.sig, self.bands = (np.array(group.column(c).to_pylist(), np.int64) for c in ("sig", "bands"))
        self.texts, self.shingler, self.sets = group.column("text"), shingler, {}

    def of(self, i: int) -> np.ndarray:
        if i not in self.sets:
            self.sets[i] = self.shingler.sets(self.texts[i].as_py())
        return self.sets[i]

    def candidates(self, i: int, others: np.ndarray) -> np.ndarray:
        """Of these members, those in another component that may be similar and meet i in no earlier band than here."""
        others = others[(self.comp[others] != self.comp[i]) & (self.rep[others] != self.pivot[i]) & (self.rep[i] != self.pivot[others])]
        n = self.n[others]
        others = others[100 * np.minimum(n, self.n[i]) >= PERCENT * np.maximum(n, self.n[i])]
        x = (self.sig[others] ^ self.sig[i]).view(np.uint64)
        for step in STEPS:
            x = x | (x >> np.uint64(step))
        others = others[np.bitwise_count(x & np.uint64(ONES)).sum(axis=1) <= HASHES - NEEDED]
        here = int(np.flatnonzero(self.bands[i] == self.key)[0])
        return others[(self.bands[others] == self.bands[i]).argmax(axis=1) == here] if len(others) else others

    def links(self) -> Iterator[tuple[int, int]]:
        left, right = np.flatnonzero(self.own == self.lo), np.flatnonzero(self.own == self.hi)
        for i in left.tolist():
            others = self.candidates(i, right[right > i] if self.lo == self.hi else right)
            if not len(others):
                continue
            own, sets = self.of(i), [self.of(j) for j in others.tolist()]
            sizes = np.array([len(s) for s in sets])
            every = np.concatenate(sets)
            found = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
            common = np.add.reduceat(found, np.cumsum(sizes) - sizes, dtype=np.int64)
            for j in others[100 * common >= PERCENT * (len(own) + sizes - common)].tolist():
                if self.comp[j] != self.comp[i]:
                    self.comp[self.comp == self.comp[j]] = self.comp[i]
                    yield int(self.rep[i]), int(self.rep[j])


def _across(members: DataFrame) -> DataFrame:
    """Links between members of a bucket that lie in different components, found block by block."""
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    rows = members.join(settle(sizes, "op3-sizes"), "key").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("blocks", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        held: list[pa.RecordBatch] = []
        for batch in _with_end(batches):
            held += [batch] if batch is not None else []
            table = pa.Table.from_batches(held) if held else None
            if table is None or not len(table):
                continue
            marks = np.stack([table.column(c).to_numpy() for c in ("key", "lo", "hi")])
            edges = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            bounds = [0, *edges.tolist(), *([len(table)] if batch is None else [])]
            found = [p for a, b in zip(bounds, bounds[1:]) if b - a > 1 for p in Block(table.slice(a, b - a), shingler).links()]
            held = table.slice(bounds[-1]).to_batches()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], ["u", "v"])
    dealt = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return settle(dealt.mapInArrow(run, "u long, v long"), "op3-more-links")


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    signed = settle(signatures(docs), "op3-signatures")
    real = signed.where("n_shingles > 0 and doc_id is not null")
    classes = settle(real.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "op3-classes")
    buckets = classes.select("rep", F.explode("bands").alias("key"))
    pivots = settle(buckets.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("n")).where("n > 1").select("key", "pivot"), "op3-pivots")
    members = settle(buckets.join(pivots, "key"), "op3-members")
    sigs = classes.select("rep", "sig")
    texts = settle(apart(docs).join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "op3-texts")

    star = members.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    star = star.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
    links = _confirmed(settle(star.where(similar(F.col("sig_a"), F.col("sig_b"))).select("a", "b"), "op3-star"), texts)
    first = components(links).withColumnRenamed("node", "rep")

    placed = settle(members.join(first, "rep", "left").select("key", "pivot", "rep", F.coalesce("component", "rep").alias("comp")), "op3-placed")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    whole = texts.select(F.col("doc_id").alias("rep"), "text")
    more = _across(placed.join(settle(mixed, "op3-mixed"), "key", "left_semi").join(classes.drop("s1", "s2"), "rep").join(whole, "rep"))
    last = components(links.unionByName(more)).withColumnRenamed("node", "rep")

    names = settle(classes.join(last, "rep", "left").select("s1", "s2", F.col("n_shingles").alias("n"), F.coalesce("component", "rep").alias("component")), "op3-names")
    same = (signed["s1"] == names["s1"]) & (signed["s2"] == names["s2"]) & (signed["n_shingles"] == names["n"]) & signed["doc_id"].isNotNull()
    out = signed.join(names, same, "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each group, with its own columns."""
    drops = settle(link(docs).where("not kept").select(F.col("doc_id").alias("drop_id")).distinct(), "op3-drops")
    return docs.join(drops, F.col("doc_id") == F.col("drop_id"), "left_anti")


ship(__name__)
