"""Tables in the shared folder that cut a plan's lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that one task joins or groups.
TASK_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder; a temporary one where there is none, in local mode alone."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("quarry.scratch.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("quarry.scratch.dir", at)
    return at.rstrip("/")


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Write once, read back: iterative plans stay small and survive lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by hash of the keys, in as many tasks as ``rows`` rows need; a few stay as they are.

    A task's memory then stays the same, however large a table and however few
    partitions a shuffle has by default.
    """
    if rows <= TASK_ROWS:
        return df
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(own, -(-rows // TASK_ROWS)), *keys)
