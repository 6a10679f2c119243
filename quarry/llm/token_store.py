"""Token ids in Parquet list columns, written in order and read selectively.

Documents are range-partitioned by id (and by a hash of the text, so that many
rows of one id are split too) and sorted, then encoded in order with a running
count inside each partition, and written by Parquet's second-version writer:
ids are dictionary-encoded (delta-encoded where a dictionary does not pay), row
groups and pages have set sizes, and page indexes are kept, so that a reader of
a few documents or of the metadata columns alone reads little.  Global offsets
need only the totals of the partitions.

Defined results: a null or empty text has only the end id; a null doc_id comes
first; rows with the same id are ordered by the hash of their text and each is
written; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import bounded_batches, new_path
from .tokenizing import encode_texts, vocabulary


@dataclass(frozen=True)
class StoreSettings:
    end_id: int = 2
    row_group_bytes: int = 32 << 20
    page_bytes: int = 64 << 10
    dictionary: bool = True
    #: Bytes of text in a task and its file, on average.
    task_bytes: int = 32 << 20


_STORED = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
_STORED_SQL = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, settings: StoreSettings = StoreSettings(), text: str = "text") -> None:
    """Write the ids of every document under ``path``, in ascending doc_id."""
    spark, tokenizer = docs.sparkSession, tokenizer or vocabulary()
    bounded_batches(spark)
    end = np.array([settings.end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for b in batches:
            for at in range(0, b.num_rows, 200):
                some = b.slice(at, 200)
                ids = [x + end for x in encode_texts(tokenizer, some.column(1).to_pylist())]
                counts = np.array([len(x) // 4 for x in ids], np.int64)
                starts = start + np.cumsum(counts) - counts
                start += int(counts.sum())
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
                offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), pa.array(counts), pa.ListArray.from_arrays(offsets, flat)], schema=_STORED
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(spark.sparkContext.defaultParallelism, -(-size // settings.task_bytes))
    keyed = rows.withColumn("h", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    (
        ordered.mapInArrow(encode, _STORED_SQL)
        .write.option("parquet.block.size", str(settings.row_group_bytes))
        .option("parquet.page.size", str(settings.page_bytes))
        .option("parquet.page.size.row.check.min", "10")
        .option("parquet.block.size.row.check.min", "10")
        .option("parquet.enable.dictionary", str(settings.dictionary).lower())
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.page.row.count.limit", "1000")
        .option("compression", "zstd")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The stored columns; selecting some of them reads only those."""
    return spark.read.schema(_STORED_SQL).parquet(path)


def starts_of_parts(stored: DataFrame) -> np.ndarray:
    """The ids before each part: prefix sums of one number for each task that wrote.

    Only the metadata columns are read.
    """
    totals = dict(stored.groupBy("part").agg(F.sum("n_tokens")).collect())
    parts = sorted(totals)
    before = np.zeros(max(parts, default=0) + 1, np.int64)
    if parts:
        before[parts] = np.concatenate(([0], np.cumsum([totals[p] for p in parts])[:-1]))
    return before


def digest(stored: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and crc32 of the ids, from the files."""
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    before = starts_of_parts(stored)

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start = before[b.column(1).to_numpy(zero_copy_only=False)] + b.column(2).to_numpy(zero_copy_only=False)
            ids = b.column(3)
            flat, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_pylist()
            sums = [zlib.crc32(flat[x:y].data) for x, y in zip(offsets, offsets[1:])]
            counts = np.diff(np.array(offsets, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(start, pa.int64()), pa.array(counts), pa.array(sums, pa.int64())], schema=out)

    return stored.select("doc_id", "part", "local_start", "ids").mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_and_digest(docs: DataFrame, tokenizer: str | None = None, settings: StoreSettings = StoreSettings(), text: str = "text") -> DataFrame:
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, settings, text)
    return digest(read_tokens(docs.sparkSession, path))
