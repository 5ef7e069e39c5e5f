"""Connected components of an edge list, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import discard, materialize


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, component) for the nodes of edges (a long, b long); component is the smallest node reachable.

    Alternates large-star and small-star steps until the edges no longer change; every step is a combinable minimum by
    node and a join. The minima of a large-star step are written, one row for each node, so that both sides of its join
    are plain exchanges and AQE can split a node with very many neighbours. Edge order, repeats, self loops and nulls do
    not matter; no edges give no rows.
    """
    canonical = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = held = materialize(canonical(edges), small=True)
    before = None
    for _ in range(limit):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        minima = least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), small=True)
        large = canonical(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.withColumnRenamed("m", "b"))
        step = materialize(canonical(small), small=True)
        state = step.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
        discard(minima)
        discard(held)
        held = now = step
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {limit} steps")
    out = now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return out.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
