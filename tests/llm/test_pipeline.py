"""The corpus pipeline, stage by stage, against plain versions."""

import corpus_pipeline
from codesieve.llm import bpe, secret_scan
from codesieve.llm.common import settle
from tests.llm import plain

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "MinHash near-dedup", "secret scans", "packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = kept
        docs = settle(stage(spark, docs, SF), "test-stage")
        if name != "packing":
            assert docs.columns == columns
            kept = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert len(kept) == docs.count()
        if name == "language ID":
            assert len(kept) >= 0.99 * len(before) and all(before[d] == t for d, t in kept.items())
        if name == "exact dedup":
            last = {plain.lower(t): d for d, t in sorted(before.items())}
            assert set(kept) == set(last.values())
        if name == "MinHash near-dedup":
            assert set(kept) == {c for _, c in plain.near_components(list(before.items())).values()}
        if name == "secret scans":
            assert kept.keys() == before.keys()
            changed = {d for d in kept if kept[d] != before[d]}
            assert all(secret_scan.MASK in kept[d] and plain.secrets(before[d]) for d in changed)
        if name == "packing":
            encoder = bpe.Encoder(bpe.read_tokenizer(bpe.default_tokenizer()))
            assert plain.check_packing(list(before.items()), docs.collect(), encoder.encode) < 0.01


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 100
