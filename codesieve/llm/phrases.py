"""Phrase collocation mining: Toivonen's sample, one full pass over proposals and negative border, expansions until closed.

A text, with A-Z lowered, is split at punctuation and line ends into pieces and these at blanks into words. Everything is
counted by language (null: `und`), occurrences within pieces, overlaps included.

1. A sample of the documents (`share`) proposes: words and pairs found there at least `low` times.
2. A full pass counts the proposals and their negative border exactly. The border is what has only proposed parts without
   being proposed: every word, pairs of proposed words, triples of two proposed pairs. It needs no list; a task tests it.
3. Words and pairs that prove frequent without having been proposed are failures of the border. They join the proposals,
   and an expansion pass counts what they open, and what that may open in turn: pairs of frequent words that were not
   counted, and triples of pairs that are frequent or counted just now. So one expansion closes the search: then each
   phrase whose parts are all frequent has been counted once, in full. Without failures there is none.

Proposals are kept as a Bloom filter of at most `max_bits` bits, which is what makes the broadcast safe. A false positive
lets a phrase be counted that need not be, and never changes a count; with far more phrases than bits, more is counted.
Each task numbers words, counts runs of numbers in arrays of bounded size and sends sums; keys that shuffle are phrases,
so equal counts meet by the phrase itself. The best rows of a language are found by ranking within shares of it first.

Null or empty text has no words and no rows; a repeated row counts again; doc_id and other columns are not looked at. A
language without candidates gives no row, nor does an empty table. Texts of any length are read whole.
"""

from __future__ import annotations

from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codesieve.llm.common import settle, ship

MIN_COUNT, TOP, SHARE, LOW = 10, 2000, 1 / 8, 2
BITS_PER_PHRASE, MIN_BITS, MAX_BITS, CHUNK = 32, 1 << 20, 1 << 28, 1 << 19
#: Words a task holds before it sends what it has counted.
HELD_WORDS = 1 << 20
#: A-Z lowered, tab as blank, ends of pieces as full stops.
PLAIN = bytes(32 if b == 9 else 46 if chr(b) in ".,;:!?\n\x0b\x0c\r" else b + 32 if "A" <= chr(b) <= "Z" else b for b in range(256))
FACTOR = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def tokens(text: bytes) -> list[bytes]:
    """The words of a text; a full stop, which is in no word, ends each piece."""
    return text.translate(PLAIN).replace(b".", b" . ").split()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(FACTOR[0])
    return h ^ (h >> np.uint64(29))


def joined(*hashes: np.ndarray) -> np.ndarray:
    """One hash for consecutive words from the hashes of each."""
    out = np.zeros(len(hashes[0]), np.uint64)
    for h in hashes:
        out = mixed(out * np.uint64(FACTOR[1]) + h + np.uint64(FACTOR[2]))
    return out


class Filter:
    """Bits of the proposed phrases; without bits it holds everything."""

    def __init__(self, data: np.ndarray | None):
        self.data = data

    @staticmethod
    def spots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        return h & np.uint64(bits - 1), (h >> np.uint64(34)) * np.uint64(FACTOR[2] | 1) & np.uint64(bits - 1)

    def holds(self, h: np.ndarray) -> np.ndarray:
        if self.data is None:
            return np.ones(len(h), bool)
        a, b = self.spots(h, 8 * len(self.data))
        bit = lambda p: (self.data[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1
        return (bit(a) & bit(b)).astype(bool)


def language_hash(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass")))


def word_hashes(words: Iterable[bytes], n: int, lang: np.uint64 | np.ndarray) -> np.ndarray:
    return joined(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n) ^ lang)


def phrase_hashes(langs: list[str], phrases: list[bytes]) -> np.ndarray:
    """Hashes of phrases of one or two words."""
    known = {lang: language_hash(lang) for lang in set(langs)}
    parts = [p.split(b" ") for p in phrases]
    lang = np.array([known[x] for x in langs], np.uint64)
    pair = np.array([len(p) > 1 for p in parts], bool)
    first, last = (word_hashes([p[i] for p in parts], len(parts), lang) for i in (0, -1))
    return np.where(pair, joined(first, last), first)


def _hashed(counts: DataFrame, known: np.ndarray | None = None) -> DataFrame:
    """Hashes of words and pairs; with a filter, of those that it does not hold."""
    shared = counts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = None if shared.value is None else Filter(shared.value)
        for batch in batches:
            h = phrase_hashes(batch.column("lang").to_pylist(), batch.column("phrase").cast(pa.binary()).to_pylist())
            h = h if test is None else h[~test.holds(h)]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])
    return counts.where("size between 1 and 2").select("lang", "phrase").mapInArrow(run, "h long")


def _bits(hashes: DataFrame, bits: int) -> np.ndarray:
    """A filter of `bits` bits with the hashes of a one-column frame; tasks make partial ones, executors merge chunks."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for p in Filter.spots(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits):
                np.bitwise_or.at(data, p >> np.uint64(3), (np.uint64(1) << (p & np.uint64(7))).astype(np.uint8))
        yield from chunks({i: part for i, part in enumerate(data.reshape(-1, min(CHUNK, len(data)))) if part.any()})

    def chunks(parts: dict) -> Iterator[pa.RecordBatch]:
        for i, part in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["chunk", "data"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict = {}
        for batch in batches:
            for i, data in zip(*(c.to_pylist() for c in batch.columns)):
                part = np.frombuffer(data, np.uint8)
                parts[i] = parts[i] | part if i in parts else part
        yield from chunks(parts)

    schema = "chunk int, data binary"
    out = np.zeros(bits // 8, np.uint8)
    rows = out.reshape(-1, min(CHUNK, len(out)))
    for row in hashes.mapInArrow(partial, schema).repartition("chunk").mapInArrow(merge, schema).collect():
        rows[row["chunk"]] = np.frombuffer(row["data"], np.uint8)
    return out


class Numbers(dict):
    """Gives every new word the next number; the end of a piece is 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Counter:
    """Numbers words and counts phrases that a filter opens and an earlier one did not."""

    def __init__(self, want: Filter, done: Filter | None, sizes: tuple[int, ...]):
        self.want, self.done, self.sizes = want, done, sizes
        self.clear()

    def clear(self) -> None:
        self.numbers, self.held, self.n = Numbers({b".": 0}), {}, 0

    def add(self, lang: str, text: bytes) -> None:
        words = tokens(text)
        words.append(b".")
        self.held.setdefault(lang, []).append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.n += len(words)

    def sums(self) -> Iterator[pa.RecordBatch]:
        """Counts of what was added since the last time: (key, n), the key being language, tab and phrase."""
        names, one_by_one = pa.array(list(self.numbers), pa.binary()), list(self.numbers)
        for lang, parts in self.held.items():
            ids = np.concatenate(parts)
            head = pa.scalar(lang.encode("utf-8", "surrogatepass"), pa.binary())
            if 1 in self.sizes:
                n = np.bincount(ids)
                n[0], total = 0, len(ids) - n[0]
                seen = np.flatnonzero(n)
                yield from self.rows(head, [names.take(pa.array(seen))], n[seen])
                yield from self.rows(head, [pa.array([b""], pa.binary())], np.array([total]))
            hashes = word_hashes(one_by_one, len(one_by_one), language_hash(lang))
            now, first = self.places(ids, hashes)
            key, n = np.unique(ids[:-1][now].astype(np.int64) << 31 | ids[1:][now], return_counts=True)
            yield from self.rows(head, [names.take(pa.array(key >> 31)), names.take(pa.array(key & (1 << 31) - 1))], n)
            if 3 in self.sizes:
                at = np.flatnonzero(first)
                pair, place = np.unique(ids[at].astype(np.int64) << 31 | ids[at + 1], return_inverse=True)
                key, n = np.unique(place << 31 | ids[at + 2], return_counts=True)
                start = pair[key >> 31]
                yield from self.rows(head, [names.take(pa.array(x)) for x in (start >> 31, start & (1 << 31) - 1, key & (1 << 31) - 1)], n)
        self.clear()

    def places(self, ids: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pairs begin that are counted now, and where triples do."""
        def both(word: np.ndarray) -> np.ndarray:
            held = word[ids]
            return held[:-1] & held[1:]

        def tested(test: Filter, pairs: np.ndarray, h: np.ndarray, at: np.ndarray) -> np.ndarray:
            out = np.zeros(len(pairs), bool)
            out[at] = test.holds(h)
            return out & pairs
        word = self.want.holds(hashes)
        word[0] = False
        pairs = both(word)
        if self.done is None:
            fresh = pairs
        else:
            old_word = self.done.holds(hashes)
            old_word[0] = False
            old_pairs = both(old_word)
            fresh = pairs & ~old_pairs
        if 3 not in self.sizes:
            return fresh, fresh[:0]
        at = np.flatnonzero(pairs)
        h = joined(hashes[ids[at]], hashes[ids[at + 1]])
        open_now = tested(self.want, pairs, h, at)
        if self.done is None:
            return fresh, open_now[:-1] & open_now[1:]
        # What this pass counts may prove frequent, so it opens triples at once.
        open_now |= fresh
        open_then = tested(self.done, old_pairs, h, at)
        return fresh, open_now[:-1] & open_now[1:] & ~(open_then[:-1] & open_then[1:])

    @staticmethod
    def rows(lang: pa.Scalar, words: list[pa.Array], n: np.ndarray, step: int = 50_000) -> Iterator[pa.RecordBatch]:
        tab, blank = pa.scalar(b"\t", pa.binary()), pa.scalar(b" ", pa.binary())
        for a in range(0, len(n), step):
            parts = [w.slice(a, step) for w in words]
            phrase = pc.binary_join_element_wise(*parts, blank) if len(parts) > 1 else parts[0]
            key = pc.binary_join_element_wise(lang, phrase, tab)
            yield pa.RecordBatch.from_arrays([key.view(pa.string()), pa.array(n[a:a + step].astype(np.int64))], ["key", "n"])


def count(docs: DataFrame, want: np.ndarray | None, done: np.ndarray | None, sizes: tuple[int, ...], least: int) -> DataFrame:
    """lang, phrase, size, n of the phrases of a pass found `least` times; size 0 holds a language's words. Stored."""
    shared = docs.sparkSession.sparkContext.broadcast((want, done))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want, done = shared.value
        counter = Counter(Filter(want), None if done is None else Filter(done), sizes)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary())):
                counter.add(lang, text.as_py())
                if counter.n >= HELD_WORDS:
                    yield from counter.sums()
        if counter.n:
            yield from counter.sums()
    rows = docs.where("text <> ''").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, "key string, n long")
    # A task has summed up what it read, so its rows move as they are and are added where they meet.
    sums = rows.repartition("key").groupBy("key").agg(F.sum("n").alias("n"))
    phrase = F.substring_index("key", "\t", -1)
    size = F.when(phrase == "", F.lit(0)).otherwise(F.length(phrase) - F.length(F.replace(phrase, F.lit(" "), F.lit(""))) + 1)
    sums = sums.select(F.expr("left(key, length(key) - length(substring_index(key, '\t', -1)) - 1)").alias("lang"), phrase.alias("phrase"), size.alias("size"), "n")
    return settle(sums.where((F.col("n") >= least) | (F.col("size") == 0)), "op13-counts")


def frequent(docs: DataFrame, min_count: int = MIN_COUNT, share: float = SHARE, low: int = LOW, max_bits: int = MAX_BITS, seed: int = 13) -> DataFrame:
    """lang, phrase, size (1 to 3; 0: the language's words), n for every phrase found min_count times, exactly counted."""
    docs = docs.select(F.col("lang").alias("lang"), F.col("text").alias("text"))
    proposed = count(docs.sample(fraction=share, seed=seed), None, None, (1, 2), low)
    bits = min(max_bits, max(MIN_BITS, 1 << (BITS_PER_PHRASE * max(1, proposed.count()) - 1).bit_length()))
    want = _bits(_hashed(proposed), bits)
    found = count(docs, want, None, (1, 2, 3), min_count)
    failures = _bits(_hashed(found, want), bits)
    if failures.any():
        found = found.unionByName(count(docs, want | failures, want, (2, 3), min_count))
    return found


def scored(found: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the candidates that no longer candidate covers; numbers are exact.

    Products of counts are decimals of 38 digits: counts up to 10^16 fit.
    """
    found = settle(found.where(F.col("n") >= min_count).where("size > 0").unionByName(found.where("size = 0")), "op13-frequent")
    longer = found.where("size = 3").select("lang", F.split("phrase", " ").alias("w"), "n").select("lang", "n", F.explode(F.array(
        F.array_join(F.slice("w", 1, 2), " "), F.array_join(F.slice("w", 2, 2), " "))).alias("phrase"))
    cover = longer.groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    cover = settle(cover, "op13-cover")
    stay = found.where("size >= 2").join(cover, ["lang", "phrase"], "left").where("most is null or 100 * most < 50 * n")
    words = F.split("phrase", " ")
    cuts = stay.select("lang", "phrase", F.col("n").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left_part"),
                       F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("right_part"))
    parts = found.where("size between 1 and 2")
    left = parts.select("lang", F.col("phrase").alias("left_part"), F.col("n").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("right_part"), F.col("n").alias("r"))
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.join(left, ["lang", "left_part"]).join(right, ["lang", "right_part"])
    cuts = cuts.select("lang", "phrase", "a", "k", "l", "r", (F.lit(1_000_000) * whole("a") * whole("a")).alias("up"), (whole("l") * whole("r")).alias("down"))
    best = cuts.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct(F.expr("up div down").alias("score"), "k", "l", "r")).alias("cut"))
    total = found.where("size = 0").select("lang", F.col("n").alias("total"))
    return best.join(F.broadcast(total) if total.count() <= 10_000 else total, "lang").select(
        "lang", "phrase", "a", "cut.l", "cut.r", F.col("total").alias("n"), F.col("cut.score").cast("long").alias("score"))


def best(rows: DataFrame, top: int = TOP) -> DataFrame:
    """rank 1 to top by language: score and count descending, then the phrase.

    Two rounds rank within shares of a language, so that no task sorts a whole one."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for shares in (max(8, parts), max(4, round(parts ** 0.5))):
        rows = rows.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "_share")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, share: float = SHARE, low: int = LOW, max_bits: int = MAX_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two and three words."""
    return best(scored(frequent(docs, min_count, share, low, max_bits), min_count), top)


ship(__name__)
