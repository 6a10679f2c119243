"""Scans and sinks: text, delimited, zipped and columnar tables, model files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import encode_delimited


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files, plain or gzip; hidden files are left out."""
    return spark.read.option("pathGlobFilter", "[!._]*").text(path)


def read_lines_in_order(spark: SparkSession, path: str) -> DataFrame:
    """Lines with ``seq``, their order by the time of their file, its name and their place in it."""
    meta = F.col("_metadata")
    files = read_lines(spark, path).select(meta["file_modification_time"].alias("at"), meta["file_path"].alias("file")).distinct()
    ranks = files.orderBy("at", "file").select("file").collect()  # one row for each file
    numbered = spark.createDataFrame([(r["file"], i) for i, r in enumerate(ranks)], "file string, k long")
    # Ids grow within a partition, and a file's blocks are read in the order of their places.
    lines = read_lines(spark, path).select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("id"))
    within = F.row_number().over(Window.partitionBy("file", "block").orderBy("id"))
    placed = lines.withColumn("n", within)
    before = placed.groupBy("file", "block").agg(F.max("n").alias("size"))
    before = before.withColumn("before", F.coalesce(F.sum("size").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(before, ["file", "block"]).join(F.broadcast(numbered), "file").select("value", (F.col("k") * (1 << 40) + F.col("before") + F.col("n")).alias("seq"))


def read_zipped_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the members of zip archives, one task an archive."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for name in z.namelist():
                        with z.open(name) as f:
                            out = []
                            for line in io.TextIOWrapper(f, "utf-8"):
                                out.append(line.rstrip("\r\n"))
                                if len(out) == 10_000:
                                    yield pa.RecordBatch.from_arrays([pa.array(out)], names=["value"])
                                    out = []
                            if out:
                                yield pa.RecordBatch.from_arrays([pa.array(out)], names=["value"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("content").mapInArrow(lines, "value string")


def read_delimited(spark: SparkSession, path: str, schema: str, delimiter: str = ",") -> DataFrame:
    return spark.read.schema(schema).option("sep", delimiter).option("escape", '"').option("pathGlobFilter", "*.{csv,gz}").csv(path)


def write_delimited(df: DataFrame, path: str, delimiter: str = ",") -> None:
    """Compressed lines with quotes only where needed."""
    df.select(encode_delimited([F.col(c) for c in df.columns], delimiter).alias("value")).write.option("compression", "gzip").text(path)


def write_factors(rows: DataFrame, path: str, key: str) -> None:
    """``id<TAB>f1,f2,…`` lines."""
    line = F.concat(F.col(key).cast("string"), F.lit("\t"), F.array_join(F.col("features").cast("array<string>"), ","))
    rows.select(line.alias("value")).write.option("compression", "gzip").text(path)


def read_factors(spark: SparkSession, path: str, key: str) -> DataFrame:
    parts = F.split("value", "\t")
    return read_lines(spark, path).select(parts[0].cast("long").alias(key), F.split(parts[1], ",").cast("array<float>").alias("features"))


def read_known_items(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", "\t")
    return read_lines(spark, path).select(parts[0].cast("long").alias("user_id"), F.split(parts[1], ",").cast("array<bigint>").alias("items"))
