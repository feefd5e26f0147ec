"""The corpus pipeline: documents through five of the training-data operators, each stage written and read again.

1. language ID: documents whose language is not recognised go.
2. exact dedup: of equal texts one document stays.
3. MinHash near-dedup: of each group of similar documents one stays.
4. secret scans: live-looking credentials are blanked out in the text; the documents stay.
5. packing: the pieces of the documents in windows of tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codesieve.llm import exact_dedup, language_id, near_dedup, packing, secret_scan
from codesieve.llm.common import settle

STAGES = [
    ("language ID", lambda spark, docs, sf_dir: language_id.accepted(docs)),
    ("exact dedup", lambda spark, docs, sf_dir: exact_dedup.deduplicate(docs)),
    ("MinHash near-dedup", lambda spark, docs, sf_dir: near_dedup.deduplicate(docs)),
    ("secret scans", lambda spark, docs, sf_dir: secret_scan.redact(docs)),
    ("packing", lambda spark, docs, sf_dir: packing.pieces(docs)),
]
#: Classifiers, tokenizers and similarity links are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), "pipeline-" + name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
