"""Registered queries of files as bytes."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.operators import binaries
from codesieve.sources.raw_files import raw_files


def build() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "binary_sniff": lambda s, d: binaries.sniffed(raw_files(s, d)),
        "decode_chain": lambda s, d: binaries.decoded(raw_files(s, d)).select("path", "encoding", F.length("content").alias("n_chars"), F.md5("content").alias("digest")),
        "file_info": lambda s, d: binaries.file_info(s, f"{d}/documents.parquet", "*.parquet").drop("modified"),
    }
