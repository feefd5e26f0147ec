"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from codesieve.plans.queries import build_registry
from codesieve.session import local_session
from codesieve.sources.tables import INPUT_PARTS

HEADLINE = ["sec_all", "scan_verdict", "generic_naming", "magic_numbers", "halstead", "ngram_repetition", "token_entropy",
            "token_diversity", "nesting_depth", "cognitive", "maintainability", "com_verbose",
            "redundant_comments", "class_metrics", "parse_diff", "review_totals", "classify_imports", "rpc_dispatch",
            "overall_confidence", "gate_verdicts", "dup_blocks", "confidence_statistical", "confidence_pattern"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, memory="20g")
    # The bench table is one row group: deal it to the cores.
    spark.conf.set(INPUT_PARTS, cpus if cpus.isdigit() else "8")
    registry = build_registry()
    wanted = os.environ.get("BENCH_QUERIES")
    # One small run starts the session's workers, so that no query pays for it.
    registry["line_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings: dict[str, float] = {}
    for key in wanted.split(",") if wanted else HEADLINE:
        start = time.perf_counter()
        registry[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[key] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
