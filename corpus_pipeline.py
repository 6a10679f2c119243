"""A training-data pipeline over ``documents``, one operator a stage.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; all but the last return the columns of ``documents``.

- quality classifier: documents scored below the threshold go;
- MinHash near-dedup: one document of each group stays (5-word shingles, 0.8);
- benchmark decontamination: documents that hold a test item go;
- secret scan: secrets are replaced in the text, and n_chars follows;
- packing: what is left becomes full sequences, one row for each piece.

Defined results of the stages: a null or empty text has a score like any other
text's form, is never a near copy or a leak, has no secret and is packed as its
separator alone; rows without a doc_id are judged by their text and stay in
near-dedup, every one; of near copies the text with the smallest doc_id stays,
of several under that id the one with the smallest hash; repeated rows are one
document from near-dedup on; very long texts are read whole; an empty table, or
empty labels or test items, give empty or unchanged results; further columns of
``documents`` are carried along whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, minhash_dedup, packing, quality_classifier, secret_scan
from quarry.llm.queries import fold
from quarry.llm.storage import discard, materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranking = quality_classifier.train(docs, table(spark, sf_dir, "labels"), fold(5) != 0)
    return quality_classifier.score(docs, ranking, keep=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secret_scan.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs).drop("ids")


STAGES = [
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secrets),
    ("packing", pack),
]

#: A classifier and trained models can't be told in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            out = materialize(out, name)
            discard(docs)
        docs = out
    return docs
