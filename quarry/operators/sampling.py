"""Sampling by keyed uniforms, so that results do not depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.random import fold, uniform
from .topk import top, top_per_group


def weighted_sample(df: DataFrame, n: int, key: str, weight: str, seed: int = 1729, group: list[str] | None = None) -> DataFrame:
    """Without replacement: the n largest ln(u)/w, in each group if given."""
    drawn = df.where(F.col(weight) > 0).withColumn("_draw", F.ln(F.greatest(uniform(F.col(key), seed), F.lit(1e-300))) / F.col(weight))
    out = top_per_group(drawn, n, group, "_draw", key) if group else top(drawn, n, "_draw", key)
    return out.drop("_draw")


def weighted_draws(df: DataFrame, n: int, key: str, weight: str, seed: int = 1729) -> DataFrame:
    """With replacement: n draws, each the row whose cumulative share holds it.

    Rows are placed by a running sum within hash buckets and bucket totals, so
    no single task holds the table; draws fall on a bucket, then on a row.
    """
    spark = df.sparkSession
    rows = df.where(F.col(weight) > 0).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(1024)))
    totals = rows.groupBy("_bucket").agg(F.sum(weight).alias("w")).orderBy("_bucket").collect()
    ends, at = [], 0.0
    for r in totals:
        ends.append((r["_bucket"], at, at + r["w"]))
        at += r["w"]
    if not ends:
        return df.limit(0).withColumn("draw", F.lit(0).cast("long"))
    buckets = spark.createDataFrame(ends, "_bucket long, _from double, _to double")
    draws = spark.range(n).select(F.col("id").alias("draw"), (uniform(F.col("id"), seed) * at).alias("_u"))
    placed = draws.join(F.broadcast(buckets), (F.col("_u") >= F.col("_from")) & (F.col("_u") < F.col("_to")))
    w = Window.partitionBy("_bucket").orderBy(key)
    summed = rows.withColumn("_end", F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = placed.withColumn("_in", F.col("_u") - F.col("_from")).join(summed, "_bucket").where("_in >= _end - " + weight + " and _in < _end")
    return inside.select("draw", *df.columns)


def bernoulli(df: DataFrame, rate: float, key: str, seed: int = 1729) -> DataFrame:
    """Each row with probability ``rate``, by its key."""
    return df.where(uniform(F.col(key), seed) < rate)


def with_fold(df: DataFrame, folds: int, key: str, seed: int = 1729) -> DataFrame:
    return df.withColumn("fold", fold(F.col(key), folds, seed))


def in_tree(example: Column, tree: Column, trees: int, folds: int) -> Column:
    """Whether an example trains a tree: trees share examples by its hash."""
    return F.pmod(F.pmod(example, F.lit(trees)) - tree, F.lit(trees)) < folds


def first_per_fold(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy("fold").orderBy(key))).where("_n = 1").drop("_n")


def spread(df: DataFrame, key: str, parts: int, copies: int, seed: int = 1729) -> DataFrame:
    """Each row to ``copies`` different ones of ``parts`` parts."""
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.struct(uniform(F.concat(F.col(key).cast("string"), F.lit(":"), i.cast("string")), seed).alias("u"), i.alias("i"))))
    return df.withColumn("part", F.explode(F.transform(F.slice(order, 1, copies), lambda s: s["i"])))
