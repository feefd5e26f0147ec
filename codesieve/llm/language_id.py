"""Language ID: nearest centroid of normalised TF-IDF n-gram vectors, several per language, with rejection by distance.

A text becomes counts of its letter n-grams (1 to 3 long, case folded, other characters as one blank) in DIMS hashed
places. Document frequencies come from every training row; the centroids of each language from spherical k-means over a
sample of about SAMPLE of its rows (a documented bound, drawn by hash), one group per language. Every text takes the
language of the centroid with the largest cosine, its score. It is `rejected` where that cosine lies below the floor of
that language (SLACK times the smallest that a sampled row of it has to its own nearest centroid).

Null texts and texts without a letter are `und`, score 0, rejected; so is everything where there is no training row. A
null lang or a null doc_id is not trained on. Ties go to the language first in order. Repeated rows are judged alike.
Texts of any length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import sys
import types
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import ship, small_batches

DIMS, SAMPLE, CENTROIDS, SLACK, STEP = 4096, 400, 4, 0.7, 1 << 20
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def letters() -> np.ndarray:
    """Which code points are letters; made once in each worker."""
    store = sys.modules.setdefault("_codesieve_worker", types.ModuleType("_codesieve_worker")).__dict__
    if "letters" not in store:
        store["letters"] = np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)])
    return store["letters"]


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of a text's n-grams by place; None without a letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    real = letters()[codes]
    if not real.any():
        return None
    before = np.concatenate(([False], real[:-1]))
    codes, real = np.where(real, codes, 32)[real | before], real[real | before]
    codes = np.concatenate(([32], codes, [32] if real[-1] else [])).astype(np.uint32)
    counts = np.zeros(DIMS, np.int64)
    for n in (1, 2, 3):
        for at in range(0, len(codes) - n + 1, STEP):
            stop = min(at + STEP, len(codes) - n + 1)
            key = np.full(stop - at, n, np.uint32)
            for k in range(n):
                key = (key ^ codes[at + k:stop + k]) * np.uint32(0x9E3779B1)
                key ^= key >> np.uint32(15)
            counts += np.bincount((key >> np.uint32(7)) & np.uint32(DIMS - 1), minlength=DIMS)
    return counts


def vectors(counts: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """Rows of weight 1: damped counts times inverse document frequencies."""
    v = np.log1p(np.array(counts, np.float32)) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def centroids(v: np.ndarray, k: int = CENTROIDS, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Spherical k-means from far-apart starts; also the smallest cosine of a row to its nearest centroid."""
    mean = v.mean(axis=0)
    c = (mean / max(np.linalg.norm(mean), 1e-12))[None]
    while len(c) < min(k, len(v)):
        c = np.vstack([c, v[(v @ c.T).max(axis=1).argmin()]])
    for _ in range(rounds):
        own = (v @ c.T).argmax(axis=1)
        sums = np.array([v[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32), float((v @ c.T).max(axis=1).min())


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: documents by language (place -1) and documents by place."""
    seen: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            counts = gram_counts(text)
            if counts is not None:
                total = seen.setdefault(lang, np.zeros(DIMS + 1, np.int64))
                total[:-1] += counts > 0
                total[-1] += 1
    for lang, total in seen.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(np.where(at == DIMS, -1, at).astype(np.int32)), pa.array(total[at])], ["lang", "place", "n"])


def fit(rows: DataFrame, sample: int = SAMPLE) -> dict:
    """A model from the columns text and lang: idf, centroids, their languages and the floors of these."""
    counted = rows.where("lang is not null").select("lang", "text").mapInArrow(_frequencies, "lang string, place int, n long")
    table = counted.groupBy("lang", "place").agg(F.sum("n").alias("n"))
    by_place, per_lang = np.zeros(DIMS), {}
    for r in table.collect():
        if r["place"] < 0:
            per_lang[r["lang"]] = r["n"]
        else:
            by_place[r["place"]] += r["n"]
    idf = (np.log((1 + sum(per_lang.values())) / (1 + by_place)) + 1).astype(np.float32)
    model = {"idf": idf, "langs": [], "centroids": np.zeros((0, DIMS), np.float32), "floors": np.zeros(0)}
    if not per_lang:
        return model

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        counts = [c for c in map(gram_counts, group["text"]) if c is not None]
        if not counts:
            return pd.DataFrame({"lang": [], "centroid": [], "floor": []})
        c, least = centroids(vectors(counts, idf))
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centroid": [x.tobytes() for x in c], "floor": SLACK * least})
    share = F.lit(0.0)
    for lang, n in per_lang.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample / n))).otherwise(share)
    drawn = rows.where("lang is not null and text is not null").select("lang", "text").where(
        F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 30)) < share * (1 << 30))
    found = drawn.groupBy("lang").applyInPandas(learn, "lang string, centroid binary, floor double").collect()
    found.sort(key=lambda r: (r["lang"], r["centroid"]))
    model["langs"], model["floors"] = [r["lang"] for r in found], np.array([r["floor"] for r in found])
    model["centroids"] = np.array([np.frombuffer(r["centroid"], np.float32) for r in found]).reshape(-1, DIMS)
    return model


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs as the struct `row`, with lang_pred, score and rejected."""
    spark, names = docs.sparkSession, docs.columns
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def judge(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        out = []
        for at in range(0, len(texts), 128):
            counts = [gram_counts(t) for t in texts.iloc[at:at + 128]]
            known = [c for c in counts if c is not None]
            best = iter(vectors(known, m["idf"]) @ m["centroids"].T if known and m["langs"] else [])
            for c in counts:
                cosines = next(best) if c is not None and m["langs"] else None
                if cosines is None:
                    out.append((UNKNOWN, 0.0, True))
                else:
                    i = int(cosines.argmax())
                    score = float(min(1.0, max(0.0, cosines[i])))
                    out.append((m["langs"][i], score, score < m["floors"][i]))
        return pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    return whole.withColumn("found", judge(F.col("row.text"))).select("row", "found.*")


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Fit on the rows that are not held out, then judge all."""
    training = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    return predict(docs, fit(training, sample))


def accepted(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows whose language is recognised, with their own columns."""
    return identify(docs, sample).where(~F.col("rejected")).select("row.*")


def decisions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row."""
    return identify(docs.select("doc_id", "text", "lang")).select(
        F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


ship(__name__)
