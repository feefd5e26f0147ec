"""Scratch tables in the shared folder, and small column helpers."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship(module: str) -> None:
    """Send a module's functions to executors by value, so that they need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only where it is unset, in plain local mode (one machine): a temporary folder. A cluster has to name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        folder = tempfile.mkdtemp(prefix="codesieve-")
        spark.conf.set("spark.checkpoint.dir", folder)
        return folder
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it again: its lineage ends there, and lost executors cost no more."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers 1,000 rows at a time, unless the session names another number than Spark's 10,000.

    A batch stands in the executor's and the worker's memory several times over, and documents may be long.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def ascii_lower(text: Column) -> Column:
    """A-Z only; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def apart(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns an operator reads; extra columns, whatever their names, stay outside."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
