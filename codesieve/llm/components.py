"""Connected components of a distributed graph, by alternating large and small stars.

Each round points every node and its larger neighbours to the smallest node near it; rounds go on until the edges no
longer change, a logarithmic number in practice. Every round is written to the shared folder. Only counts reach the
driver. A node with very many neighbours is one key of a join, whose large side Spark splits; its minimum is combined
before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import settle


def _hooked(edges: DataFrame) -> DataFrame:
    """The edges with the smallest v of each u beside them; stored minima let Spark split a node of many edges."""
    return edges.join(settle(edges.groupBy("u").agg(F.min("v").alias("m")), "minima"), "u")


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest member) for every node of the columns u and v; nulls and loops are no edges."""
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = settle(now, "components")
    state = _print(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hooked(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = _hooked(large)
        pairs = small.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
        now, before = settle(pairs.where("u <> v").distinct(), "components"), state
        state = _print(now)
        if state == before:
            break
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
