"""String ids to 64-bit ids and back, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hashed(name: Column) -> Column:
    """First eight bytes, lowest first, of the MD5 of the UTF-16LE characters."""
    digest = F.md5(F.encode(name, "UTF-16LE"))
    turned = F.concat(*(F.substring(digest, 2 * i + 1, 2) for i in range(7, -1, -1)))
    return F.conv(turned, 16, -10).cast("long")


def to_long(name: Column) -> Column:
    """Numbers of up to 18 digits stand for themselves, others are hashed."""
    return F.when(name.rlike(r"^-?\d{1,18}$"), F.try_to_number(name, F.lit("S" + "9" * 18)).cast("long")).otherwise(hashed(name))


def mapping(df: DataFrame, *columns: str) -> DataFrame:
    """(id, name) for every string that is not its own number."""
    names = df.select(F.explode(F.array(*(F.col(c).cast("string") for c in columns))).alias("name")).where("name is not null")
    own = names.select(to_long(F.col("name")).alias("id"), "name").where("cast(id as string) <> name")
    return own.groupBy("id").agg(F.min("name").alias("name"))


def collisions(df: DataFrame, *columns: str) -> DataFrame:
    """(id, names): ids that stand for several strings, of which ``mapping`` keeps the first."""
    names = df.select(F.explode(F.array(*(F.col(c).cast("string") for c in columns))).alias("name")).where("name is not null").distinct()
    own = names.select(to_long(F.col("name")).alias("id"), "name").groupBy("id").agg(F.count("*").alias("names"))
    return own.where("names > 1")


def read_mapping(lines: DataFrame, column: str = "value", delimiter: str = ",") -> DataFrame:
    """(id, name) of saved ``id,name`` lines; the name may have the delimiter in it."""
    parts = F.split(F.col(column), f"[{delimiter}]", 2)
    return lines.select(parts[0].try_cast("long").alias("id"), parts[1].alias("name")).where("id is not null and name is not null")


def decode(df: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """Replace a 64-bit id by its string, or by its digits where it has none."""
    own = names.select(F.col("id").alias("_id"), F.col("name").alias("_name"))
    return df.join(own, F.col(column) == F.col("_id"), "left").withColumn(column, F.coalesce("_name", F.col(column).cast("string"))).drop("_id", "_name")
