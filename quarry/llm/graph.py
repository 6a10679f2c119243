"""Connected components on edge tables, without collecting them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize


def _signature(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for edges (a, b); the component is its smallest node.

    Alternates the large-star and small-star operations until nothing changes.
    Minima are combined map-side, tables are cut from their lineage every round
    and neighbours are never gathered in one row, so a hot node costs no more
    than its edges; joins on it can be split at run time.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while (state := _signature(now)) != before:
        before = state
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "star")
        large = materialize(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        low2 = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "star")
        moved = large.join(low2, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = materialize(moved.union(low2.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(now, low, large, low2)
        now = small
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(now.groupBy(F.col("b").alias("node")).agg(F.min("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
