"""Shared-folder tables: how operators cut lineage and survive lost executors.

Intermediate tables go to the folder named in ``spark.checkpoint.dir`` (every
executor and the driver see it), or in the context's checkpoint folder.  Only
where there is neither and Spark runs in this process is a temporary one made.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text handed to a Python worker at once; Spark's own bound of a batch's
#: bytes (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB) cuts batches of long texts.
TEXT_ROWS_PER_BATCH = 1000


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder; a fresh local one where there is none, in local mode alone."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("quarry.scratch.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("quarry.scratch.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    The reread plan has no lineage behind it and real file statistics, so the
    optimizer can choose joins by size.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return reread(spark, path, df.schema)


def reread(spark: SparkSession, path: str, schema) -> DataFrame:
    df = spark.read.schema(schema).parquet(path)
    df._quarry_path = path
    return df


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``materialize`` that no plan needs any more."""
    for df in tables:
        path = getattr(df, "_quarry_path", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small enough for a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_ROWS_PER_BATCH:
        spark.conf.set(key, str(TEXT_ROWS_PER_BATCH))


def whole_runs(batches: Iterator[pa.RecordBatch], units: int) -> Iterator[pa.RecordBatch]:
    """Batches anew, so that no run of equal values in the first ``units`` columns is cut."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        own = [b.column(i).to_numpy(zero_copy_only=False) for i in range(units)]
        new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in own]))
        if held and last != [c[0] for c in own]:
            yield pa.concat_batches(held)
            held = []
        cut = int(new[-1]) + 1 if len(new) else 0
        if cut:
            yield pa.concat_batches([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
        last = [c[-1] for c in own]
    if held:
        yield pa.concat_batches(held)


def hash_sample(df: DataFrame, rows: int, *keys: str, seed: int = 0) -> DataFrame:
    """About ``rows`` rows, chosen by a hash of the keys; all where there are fewer.

    Only the count comes to the driver, and nothing is sorted, so the cost does
    not depend on how many partitions there are.
    """
    total = df.count()
    if total <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 30)) < int(rows / total * (1 << 30)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
