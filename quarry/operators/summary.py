"""Column summaries: one pass for numbers, one for categories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NUMBERS = ("n", "missing", "min", "max", "mean", "stddev")


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each column; a column without a number is all zeros.

    The standard deviation is the population's; NULL and NaN are missing.
    """
    aggs = []
    for c in columns:
        x = F.nullif(F.col(c).cast("double"), F.lit(float("nan")))
        aggs.append(
            F.struct(
                F.lit(c).alias("column"), F.count(x).alias("n"), F.count_if(x.isNull()).alias("missing"),
                *(F.coalesce(f(x), F.lit(0.0)).alias(a) for f, a in ((F.min, "min"), (F.max, "max"), (F.avg, "mean"), (F.stddev_pop, "stddev"))),
            )
        )
    return df.agg(F.array(*aggs).alias("s")).select(F.inline("s"))


def histogram(df: DataFrame, columns: list[str], cap: int = 1_000_000) -> DataFrame:
    """(column, level, n), the alphabetically first ``cap`` levels, and whether some were left out."""
    pairs = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns))).alias("p")).select("p.*")
    counts = pairs.where("level is not null").groupBy("column", "level").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("column").agg(F.count("*").alias("size"))
    sized = counts.join(sizes, "column").withColumn("trimmed", F.col("size") > cap)
    if sizes.where(F.col("size") > cap).isEmpty():
        return sized.drop("size")
    rank = F.row_number().over(Window.partitionBy("column").orderBy("level"))
    kept = sized.where("trimmed").withColumn("rank", rank).where(F.col("rank") <= cap).drop("rank")
    return sized.where("not trimmed").union(kept).drop("size")


def to_json(summary: DataFrame) -> DataFrame:
    return summary.select("column", F.to_json(F.struct(*(F.col(c) for c in summary.columns if c != "column"))).alias("json"))


def counted(df: DataFrame, columns: list[str]) -> dict[str, dict[str, float]]:
    """The numeric summary on the driver: one small row for each column."""
    return {r["column"]: {k: r[k] for k in NUMBERS} for r in numeric_summary(df, columns).collect()}


class TooManyLevels(ValueError):
    """A column has more levels than a vector may have places."""


def levels(df: DataFrame, columns: list[str], cap: int = 1_000_000) -> dict[str, list[str]]:
    """Sorted levels of each categorical column; TooManyLevels beyond the cap."""
    out: dict[str, list[str]] = {c: [] for c in columns}
    if columns:
        for r in histogram(df, columns, cap).select("column", "level", "trimmed").orderBy("column", "level").collect():
            if r["trimmed"]:
                raise TooManyLevels(f"column {r['column']} has more than {cap} levels")
            out[r["column"]].append(r["level"])
    return out


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that have every column."""
    return df.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns), F.lit(True)))
