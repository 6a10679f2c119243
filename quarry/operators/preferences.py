"""Preference triples: parsing, merging generations, known items.

The same merge serves batch generations and streaming micro-batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.text import decode_delimited, finite_double
from ..plans.storage import dealt


def parse_lines(lines: DataFrame, column: str = "value", delimiter: str = ",") -> DataFrame:
    """``user,item[,strength]``: strength 1 by default; an empty one deletes."""
    f = decode_delimited(F.col(column), 4, delimiter)
    raw = lines.select(f.alias("f"), (F.size(F.split(F.col(column), f"[{delimiter}]")) < 3).alias("short")).where("size(f) >= 2")
    value = F.when(F.col("short"), F.lit(1.0)).otherwise(finite_double(F.col("f")[2]))
    is_delete = ~F.col("short") & (F.col("f")[2] == "")
    out = raw.select(F.col("f")[0].alias("user"), F.col("f")[1].alias("item"), value.cast("float").alias("value"), is_delete.alias("is_delete"))
    return out.where("is_delete or value is not null")


def with_ids(prefs: DataFrame) -> DataFrame:
    return prefs.withColumns({"user_id": ids.to_long(F.col("user").cast("string")), "item_id": ids.to_long(F.col("item").cast("string"))})


def merge(old: DataFrame, new: DataFrame, decay: float = 1.0, zero_threshold: float = 0.0, rows: int = 0) -> DataFrame:
    """Old values decay, a delete removes an old value, new values add up.

    ``old`` has (user_id, item_id, value); ``new`` also has ``is_delete``.  A
    delete does not cancel what the same batch adds.  One aggregation, in tasks
    of bounded rows where ``rows`` says how many both have.
    """
    both = old.select("user_id", "item_id", F.col("value").cast("double").alias("before"), F.lit(None).cast("double").alias("added"), F.lit(False).alias("is_delete")).unionByName(
        new.select("user_id", "item_id", F.lit(None).cast("double").alias("before"), F.when(~F.col("is_delete"), F.col("value").cast("double")).alias("added"), "is_delete")
    )
    return merged(dealt(both, rows, "user_id", "item_id"), decay, zero_threshold)


def merged(both: DataFrame, decay: float = 1.0, zero_threshold: float = 0.0) -> DataFrame:
    """What ``merge`` does, of rows (user_id, item_id, before, added, is_delete)."""
    kept = F.when(F.col("deleted"), 0.0).otherwise(F.coalesce("before", F.lit(0.0)) * decay)
    grouped = both.groupBy("user_id", "item_id").agg(F.sum("before").alias("before"), F.sum("added").alias("added"), F.bool_or("is_delete").alias("deleted"))
    out = grouped.select("user_id", "item_id", (kept + F.coalesce("added", F.lit(0.0))).alias("value"))
    return out.where(F.abs("value") > zero_threshold)


def merge_in_order(prefs: DataFrame, zero_threshold: float = 0.0) -> DataFrame:
    """Adds and deletes in the order of ``seq``: what follows the last delete."""
    last = F.max(F.when(F.col("is_delete"), F.col("seq")))
    dated = prefs.groupBy("user_id", "item_id").agg(F.coalesce(last, F.lit(-1).cast("long")).alias("cut"))
    after = prefs.join(dated, ["user_id", "item_id"]).where("not is_delete and seq > cut")
    return after.groupBy("user_id", "item_id").agg(F.sum(F.col("value").cast("double")).alias("value")).where(F.abs("value") > zero_threshold)


def transpose(r: DataFrame) -> DataFrame:
    return r.select(F.col("item_id").alias("user_id"), F.col("user_id").alias("item_id"), "value")


def known_items(r: DataFrame) -> DataFrame:
    """(user_id, items), sorted."""
    return r.groupBy("user_id").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def vectors(r: DataFrame, key: str, other: str) -> DataFrame:
    """(key, entries): the sparse row of each key, sorted by id."""
    return r.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(other).alias("id"), "value"))).alias("entries"))


def popularity(r: DataFrame) -> DataFrame:
    """(item_id, value): how many users know each item."""
    return r.select("user_id", "item_id").distinct().groupBy("item_id").agg(F.count("*").cast("double").alias("value"))


def known_to_all(r: DataFrame, users: list[int]) -> DataFrame:
    """Items that every listed user with known items knows."""
    own = r.where(F.col("user_id").isin(users)).select("user_id", "item_id").distinct()
    n = own.agg(F.count_distinct("user_id").alias("n_users"))
    return own.groupBy("item_id").agg(F.count("*").alias("n")).join(F.broadcast(n), F.col("n") == F.col("n_users")).select("item_id")


def near_zero(value: Column, threshold: float) -> Column:
    return F.abs(value) <= threshold


def prune_stale(rows: DataFrame, fresh: DataFrame, recent: DataFrame, key: str) -> DataFrame:
    """Rows in the new generation or active since; the rest goes."""
    return rows.join(fresh.select(key).union(recent.select(key)).distinct(), key, "left_semi")
