"""Top-n with a fixed order: value descending, then id ascending."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_per_group(df: DataFrame, n: int, group: list[str], value: str = "value", tie: str = "item_id", rank: str | None = None) -> DataFrame:
    """Spark plans this with a limit in each task before the shuffle."""
    name = rank or "_rank"
    w = Window.partitionBy(*group).orderBy(F.desc(value), F.asc(tie))
    out = df.where(F.col(value).isNotNull()).withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def top(df: DataFrame, n: int, value: str = "value", tie: str = "item_id") -> DataFrame:
    return df.where(F.col(value).isNotNull()).orderBy(F.desc(value), F.asc(tie)).limit(n)
