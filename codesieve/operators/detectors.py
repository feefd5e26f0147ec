"""Detectors as plug-ins: registered by name, chosen by name, and unable to break a scan.

A detector turns files into findings ``(path, severity, confidence)``. One that can't even be planned, or that lacks a
column, scores 0 for every file; one written as a Python function fails file by file. Either way its fault stands in the
``error`` column beside the score and the other detectors go on.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.functions.text import lookup
from codesieve.operators import scoring

#: The selection of the quick mode: cheap detectors of high confidence.
QUICK = ("emoji", "security")
SEVERITY_WEIGHTS = dict(zip(scoring.RANK, (1.0, 0.75, 0.5, 0.25)))
FINDINGS = "path string, severity string, confidence double, error string"


@dataclass(frozen=True)
class Detector:
    """``scores`` gives ``(path, score, error)`` of every file."""

    name: str
    weight: float
    scores: Callable[[DataFrame], DataFrame]


def _built_in(name: str) -> Callable[[DataFrame], DataFrame]:
    return lambda files: scoring.confidence(files, name).select("path", "score", F.lit(None).cast("string").alias("error"))


def _from_findings(findings: Callable[[DataFrame], DataFrame], size: int, cap: float) -> Callable[[DataFrame], DataFrame]:
    def scores(files: DataFrame) -> DataFrame:
        rows = findings(files)
        error = F.col("error") if "error" in rows.columns else F.lit(None)
        weight = F.round(lookup(F.col("severity"), SEVERITY_WEIGHTS, 0.0) * F.coalesce("confidence", F.lit(0.0)) * scoring.UNITS).cast("long")
        hits = rows.select("path", F.lit(0).alias("lines"), weight.alias("w"), error.cast("string").alias("error"))
        zero = files.select("path", F.size(F.split(F.coalesce("content", F.lit("")), "\n", -1)).alias("lines"), F.lit(0).cast("long").alias("w"), F.lit(None).cast("string").alias("error"))
        # A finding of a path that is no file of the scan is not looked at.
        totals = zero.unionByName(hits).groupBy("path").agg(F.max("lines").alias("lines"), F.sum("w").alias("w"), F.max("error").alias("error")).where("lines > 0")
        score = F.least(F.lit(cap), F.col("w") / scoring.UNITS / F.greatest(F.lit(1.0), F.col("lines") / size))
        return totals.select("path", F.when(F.col("error").isNull(), score).otherwise(F.lit(0.0)).alias("score"), "error")
    return scores


def rowwise(function: Callable[[str, str | None, str], Iterable[tuple[str, float]]]) -> Callable[[DataFrame], DataFrame]:
    """Findings of a Python function ``(path, language, content) -> [(severity, confidence), ...]``; what it raises becomes the file's error."""
    schema = pa.schema([("path", pa.string()), ("severity", pa.string()), ("confidence", pa.float64()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, language, content in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    out += [{"path": path, "severity": s, "confidence": float(c), "error": None} for s, c in function(path, language, content or "")]
                except Exception as error:  # noqa: BLE001 - a plug-in's fault stays with its file
                    out.append({"path": path, "severity": None, "confidence": None, "error": f"{type(error).__name__}: {error}"})
            yield pa.RecordBatch.from_pylist(out, schema)
    return lambda files: files.select("path", "language", "content").mapInArrow(run, FINDINGS)


class Detectors:
    """A set of detectors, at first those of all phases."""

    def __init__(self, weights: dict[str, float] = scoring.PHASE_WEIGHTS):
        self._known = {name: Detector(name, weight, _built_in(name)) for name, weight in weights.items()}

    def register(self, name: str, findings: Callable[[DataFrame], DataFrame], weight: float, size: int = 100, cap: float = 0.95) -> None:
        """Add or replace a detector; a file's weighted findings are divided by its length in ``size`` lines and capped."""
        if weight <= 0:
            raise ValueError("a detector's weight must be positive")
        self._known[name] = Detector(name, weight, _from_findings(findings, size, cap))

    def names(self) -> list[str]:
        return list(self._known)

    def scores(self, files: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
        """``(path, analyzer, score, error)`` of every file and chosen detector (all by default)."""
        chosen = list(self._known if names is None else names)
        unknown = [n for n in chosen if n not in self._known]
        if unknown or not chosen:
            raise ValueError(f"no such detectors: {unknown}")
        frames = []
        for name in chosen:
            try:
                rows = self._known[name].scores(files).select("path", F.lit(name).alias("analyzer"), F.col("score").cast("double").alias("score"), "error")
            except Exception as error:  # noqa: BLE001 - one detector's fault must not end the scan
                note = F.lit(f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}")
                rows = files.select("path", F.lit(name).alias("analyzer"), F.lit(0.0).alias("score"), note.alias("error"))
            frames.append(rows)
        return reduce(lambda a, b: a.unionByName(b), frames)

    def overall(self, files: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
        """``(path, confidence, level, failed)``: the weighted mean of the chosen detectors and the names of those that failed."""
        chosen = list(self._known if names is None else names)
        weights = {n: self._known[n].weight for n in chosen if n in self._known}
        scores = self.scores(files, chosen)
        units = F.round(F.col("score") * lookup(F.col("analyzer"), weights) * scoring.UNITS).cast("long")
        rows = scores.groupBy("path").agg(F.sum(units).alias("units"), F.array_sort(F.collect_set(F.when(F.col("error").isNotNull(), F.col("analyzer")))).alias("failed"))
        confidence = F.least(F.lit(1.0), F.col("units") / scoring.UNITS / sum(weights.values()))
        return rows.select("path", confidence.alias("confidence"), scoring.confidence_level(confidence).alias("level"), "failed")
