"""Connected components by alternating large and small stars, as Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import store


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = store.written(both.groupBy("u").agg(F.min("v").alias("m")), "least")
    return (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .where("u <> v").distinct())


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = store.written(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    return (down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (bigint u, v): root is the smallest node that it reaches.

    Self edges and repeated edges are ignored; no edges give no rows.  Each
    round is written to the shared folder, and the rounds end when neither
    step changes the edges.  The minima are pre-aggregated and written too, so
    that a hub's edges meet its minimum in a join whose hot partition the
    runtime can split.
    """
    edges = store.written(edges.select("u", "v").where("u <> v").distinct(), "edges")
    before = _state(edges)
    while before[0]:
        edges = store.written(_small(store.written(_large(edges), "edges")), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select("v", "v").distinct())
