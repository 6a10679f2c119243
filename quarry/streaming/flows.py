"""Structured Streaming: ingest into generations, windows, live updates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import preferences
from ..operators.blocks import gram
from ..operators.recommend import updated_vectors
from ..plans.generation import DONE, Store
from ..plans.storage import dealt


def windowed_stats(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """count, mean, min and max by event type and window; late rows are bounded."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    source = events.withWatermark("ts", late) if events.isStreaming else events
    stats = source.groupBy(window.alias("w"), "event_type").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
    return stats.select(F.col("w.start").alias("window_start"), "event_type", "n", "mean", "low", "high")


def trailing_stats(events: DataFrame, seconds: int = 3600, key: str = "event_type", value: str = "value") -> DataFrame:
    """For each event, (event_id, n, low, high) of its key's events in the time up to it.

    Rows are dealt by key and slot of that length, each also to the next slot as
    history, so a task has one slot of a key and not the key.  An event's time is
    a beginning of its own slot and an end of the one before: both are running
    sums, so a slot costs a sort and not the square of its rows.  Events without
    a time are each other's.
    """
    micros = seconds * 1_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    slot = F.floor(at / F.lit(micros))
    copy = lambda own, by: F.struct((slot + by).alias("slot"), (at + by * micros).alias("s"), F.lit(own).alias("own"))
    copies = F.when(at.isNull(), F.array(copy(True, 0))).otherwise(F.array(copy(True, 0), copy(False, 1)))
    rows = events.select("event_id", F.col(key).alias("key"), F.col(value).alias("value"), F.inline(copies))
    rows = dealt(rows, 2 * events.count(), "key", "slot")
    slots = Window.partitionBy("key", "slot")
    upto = slots.orderBy("s").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    since = slots.orderBy(F.desc("s")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own, old = F.when(F.col("own"), F.col("value")), F.when(~F.col("own"), F.col("value"))
    stats = rows.withColumns({"n": F.count(F.when(F.col("own"), 1)).over(upto), "low": F.min(own).over(upto), "high": F.max(own).over(upto)})
    stats = stats.withColumns({"_n": F.count(F.when(~F.col("own"), 1)).over(since), "_low": F.min(old).over(since), "_high": F.max(old).over(since)})
    return stats.where("own").select("event_id", (F.col("n") + F.col("_n")).alias("n"), F.least("low", "_low").alias("low"), F.greatest("high", "_high").alias("high"))


def merge_stream(spark: SparkSession, inbound: str, schema: str, state: str, checkpoint: str, decay: float = 1.0, files: int | None = 1) -> DataFrame:
    """Merge all waiting files into the state, a micro-batch at a time; the state.

    A batch has ``files`` files, in the order of their times, or with None all
    that wait: what was written by many tasks is then one batch.
    A batch's result goes to its own numbered folder, and starts from the newest
    complete one before it, so a batch that is run again after a failure reads
    the same state and writes the same result; the last two are kept.  Without
    waiting files the state stays as it is.
    """
    empty = spark.createDataFrame([], "user_id long, item_id long, value double")
    store = Store(spark, state)

    def complete() -> list[int]:
        return [int(n) for n in store.names() if n.isdigit() and store.exists(f"{n}/{DONE}")]

    def step(batch: DataFrame, epoch: int) -> None:
        older = [e for e in complete() if e < epoch]
        old = spark.read.parquet(f"{state}/{older[-1]:08d}") if older else empty
        preferences.merge(old, batch, decay, rows=old.count() + batch.count()).write.mode("overwrite").parquet(f"{state}/{epoch:08d}")
        for e in older[:-1]:
            store.delete(f"{e:08d}")

    source = spark.readStream.schema(schema).options(**({} if files is None else {"maxFilesPerTrigger": files}))
    query = source.parquet(inbound).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    done = complete()
    return spark.read.parquet(f"{state}/{done[-1]:08d}") if done else empty


def fold_in(events: list[tuple[int, int, float]], x: DataFrame, y: DataFrame) -> tuple[dict[int, list[float]], dict[int, list[float]]]:
    """Apply events in order to the vectors they touch; new ids start at zero.

    A micro-batch's events and their vectors come to the driver; the order of
    events matters, and a batch's size is the stream's setting.
    """
    xtx, yty = gram(x), gram(y)
    k = len(yty)
    users, items = sorted({e[0] for e in events}), sorted({e[1] for e in events})
    xs = {r["user_id"]: list(r["features"]) for r in x.where(F.col("user_id").isin(users)).collect()}
    ys = {r["item_id"]: list(r["features"]) for r in y.where(F.col("item_id").isin(items)).collect()}
    for u, i, v in events:
        xs[u], ys[i] = updated_vectors(xs.get(u, [0.0] * k), ys.get(i, [0.0] * k), v, xtx, yty)
    return xs, ys


def apply_vectors(factors: DataFrame, key: str, changed: dict[int, list[float]]) -> DataFrame:
    rows = [(int(k), [float(np.float32(z)) for z in v]) for k, v in changed.items()]
    new = factors.sparkSession.createDataFrame(rows, f"{key} long, features array<float>")
    return factors.join(new.select(key), key, "left_anti").unionByName(new)
