"""Readers for the given parquet tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Session option of the library: parts to deal an input table into.
INPUT_PARTS = "spark.codesieve.inputParts"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str, always: bool = False) -> DataFrame:
    """Re-hash on a unique key into as many parts as the session asks for; by default nothing moves.

    The option is for tables stored as one row group, as in the bench; it is the caller's, whatever the table's size.
    With ``always``, rows that much work awaits are dealt out in any case, into as many parts as a shuffle of the session has.
    """
    parts = df.sparkSession.conf.get(INPUT_PARTS, None)
    if parts:
        return df.repartition(int(parts), key)
    return df.repartition(key) if always else df


def _shared_folder(spark: SparkSession) -> str | None:
    """The folder of spark.checkpoint.dir; in plain local mode a temporary one where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named or not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        return named and named.rstrip("/")
    folder = tempfile.mkdtemp(prefix="codesieve-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder once and read it again: for plans that read it many times.

    Where no shared folder is known the frame is returned as it is, and each reading derives it anew.
    """
    spark = df.sparkSession
    folder = _shared_folder(spark)
    if folder is None:
        return df
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
