"""Packing: non-negative least squares over shallow length combinations, then greedy packing of what is left.

Documents become token ids (see bpe) and an end id, kept once in the shared folder. Whole windows are cut off long
documents; the remainders are counted in bins of UNIT tokens. Combinations of up to three bins that fill a window are
columns of a matrix; non-negative least squares fits their repeat counts to the histogram (at most window / UNIT rows,
whatever the corpus). Each task then packs the documents it reads, in lanes of bounded size: it repeats each combination
as often as its share of the corpus says (rounded down), repeats it while pieces last, and lays what remains end to end,
cut at window ends. A lane's last, unfilled window is cut into powers of two, so it needs no padding. Ids never shuffle.

Null and empty texts are one end id. A row that repeats another is packed again; rows are packed in the order of the
stored files, so ties need no rule. A document longer than a lane has a lane of its own. An empty table gives none.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.llm.bpe import default_tokenizer, groups, read_tokenizer, sliced, worker_encoder
from codesieve.llm.common import apart, settle, ship, small_batches

WINDOW, UNIT, END_ID, LANE_TOKENS = 4096, 16, 2, 1 << 23
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def tokens(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, n, ids (little-endian unsigned 32-bit, the end id last) of every row, stored."""
    small_batches(docs.sparkSession)
    source = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer or default_tokenizer()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = worker_encoder(source.value, "u2")
        end = np.uint16(end_id).tobytes()
        for batch in sliced(batches):
            at = 0
            for texts in groups(batch.column("text").to_pylist()):
                ids = [b"".join(parts) + end for parts in encoder.forms(texts, table, None, np.uint16)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), pa.array([len(i) // 2 for i in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n", "ids"])
                at += len(texts)
    return settle(apart(docs).mapInArrow(run, "doc_id long, n long, ids binary"), "op4-tokens")


def combinations(units: int) -> list[tuple[int, ...]]:
    """Up to three bins, in order, that fill `units` exactly."""
    pairs = [(a, units - a) for a in range(1, units // 2 + 1)]
    triples = [(a, b, units - a - b) for a in range(1, units // 3 + 1) for b in range(a, (units - a) // 2 + 1)]
    return [(units,), *pairs, *triples]


def nnls(matrix: np.ndarray, target: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Non-negative least squares by an active set: x >= 0 that minimises |matrix x - target|."""
    x, active = np.zeros(matrix.shape[1]), np.zeros(matrix.shape[1], bool)
    for _ in range(rounds):
        slope = matrix.T @ (target - matrix @ x)
        slope[active] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= 1e-6 * max(1.0, target.sum()):
            break
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            part = matrix[:, at]
            goal = np.linalg.solve(part.T @ part + 1e-9 * np.eye(len(at)), part.T @ target)
            low = goal <= 0
            if not low.any():
                x[:] = 0
                x[at] = goal
                break
            step = np.min(x[at][low] / np.maximum(x[at][low] - goal[low], 1e-300))
            x[at] += step * (goal - x[at])
            active[at[low & (x[at] <= 1e-12)]] = False
            x[~active] = 0
    return x


def plan(histogram: dict[int, int], window: int = WINDOW, unit: int = UNIT) -> list[tuple[tuple[int, ...], float]]:
    """Combinations in use and how often each is repeated, over the whole corpus, most repeated first."""
    units = window // unit
    shapes = combinations(units)
    target = np.zeros(units)
    for size, n in histogram.items():
        target[size - 1] = n
    matrix = np.zeros((units, len(shapes)))
    for j, shape in enumerate(shapes):
        np.add.at(matrix[:, j], np.array(shape) - 1, 1)
    useful = (matrix[target == 0] == 0).all(axis=0)
    repeats = np.zeros(len(shapes))
    if useful.any():
        repeats[useful] = nnls(matrix[:, useful], target)
    return sorted(((shapes[j], float(repeats[j])) for j in np.flatnonzero(repeats)), key=lambda c: (-c[1], c[0]))


def pack_lane(lengths: np.ndarray, shapes: list[tuple[tuple[int, ...], float]], share: float, window: int, unit: int) -> list[tuple[int, int, int, int, int]]:
    """(row, start, length, sequence, offset) of the pieces of one lane; share: of the corpus's remainders."""
    out, sequence = [], 0
    for row in np.flatnonzero(lengths >= window).tolist():
        for start in range(0, lengths[row] - window + 1, window):
            out.append((row, start, window, sequence, 0))
            sequence += 1
    rest = lengths % window
    bins: dict[int, list[int]] = {}
    for row in np.flatnonzero(rest).tolist():
        bins.setdefault(-(-int(rest[row]) // unit), []).append(row)
    for repeats in ([int(n * share) for _, n in shapes], [len(lengths)] * len(shapes)):
        for (shape, _), n in zip(shapes, repeats):
            n = min([n, *(len(bins.get(b, ())) // shape.count(b) for b in shape)])
            for _ in range(n):
                offset = 0
                for row in [bins[b].pop() for b in shape]:
                    out.append((row, int(lengths[row] - rest[row]), int(rest[row]), sequence, offset))
                    offset += int(rest[row])
                sequence += 1
    left = [row for b in sorted(bins, reverse=True) for row in bins[b]]
    room, offset, todo = window, 0, int(rest[left].sum())
    if todo < window:
        room = 1 << todo.bit_length() - 1 if todo else window
    for row in left:
        start, stop = int(lengths[row] - rest[row]), int(lengths[row])
        while start < stop:
            n = min(stop - start, room - offset)
            out.append((row, start, n, sequence, offset))
            start, offset, todo = start + n, offset + n, todo - n
            if offset == room:
                sequence, offset = sequence + 1, 0
                room = window if todo >= window else 1 << todo.bit_length() - 1 if todo else window
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, unit: int = UNIT, lane_tokens: int = LANE_TOKENS) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset for every piece."""
    stored = tokens(docs, tokenizer)
    rest = F.col("n") % window
    counts = stored.where(rest > 0).groupBy(F.ceil(rest / unit).alias("size")).count().collect()
    histogram = {r["size"]: r["count"] for r in counts}
    shapes, total = plan(histogram, window, unit), max(1, sum(histogram.values()))

    def lane(rows: list[tuple], first: int) -> tuple[pa.RecordBatch, int]:
        data = [np.frombuffer(ids, "<u2") for _, ids in rows]
        lengths = np.array([len(d) for d in data], np.int64)
        pieces = pack_lane(lengths, shapes, float((lengths % window > 0).sum()) / total, window, unit)
        row, start, length, sequence, offset = (list(c) for c in zip(*pieces))
        ids = [data[r][s:s + n].astype("<u4").tobytes() for r, s, n in zip(row, start, length)]
        columns = [pa.array([rows[r][0] for r in row], pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()),
                   pa.array(lengths[row], pa.int64()), pa.array(np.array(sequence) + first, pa.int64()), pa.array(offset, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]), first + sequence[-1] + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sequences are numbered as monotonically_increasing_id() numbers rows: by task, then in order.
        first, rows, size = TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                if rows and size + len(ids) // 2 > lane_tokens:
                    done, first = lane(rows, first)
                    yield done
                    rows, size = [], 0
                rows.append((doc_id, ids))
                size += len(ids) // 2
        if rows:
            yield lane(rows, first)[0]
    return stored.select("doc_id", "ids").mapInArrow(run, PIECES)


def pieces(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Where each piece lies, with a checksum in place of its ids."""
    return pack(docs, tokenizer).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


ship(__name__)
