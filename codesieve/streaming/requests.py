"""The request loop as a stateless streaming query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.operators.requests import responses

SCHEMA = "seq BIGINT, raw STRING"


def request_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Requests arriving as JSON-lines files ``{"seq": .., "raw": ".."}`` in a shared folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", max_files).json(folder)


def answer(spark: SparkSession, folder: str, out: str, checkpoint: str):
    """Answer everything that has arrived and stop; the checkpoint, in a shared folder, makes it restartable."""
    return responses(request_stream(spark, folder)).withColumn("answered_at", F.current_timestamp()) \
        .writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()
