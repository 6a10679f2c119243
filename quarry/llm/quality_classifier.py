"""Quality scores by Bradley-Terry pairwise ranking.

Each preference pair says that a document labelled 1 beats one labelled 0; the
logistic loss on the difference of their features gives a linear score, and a
quantile of the training scores (the share of label 0) gives the threshold.
Training uses every labelled row (equal rows count once): they are dealt to
buckets, all pairs of a bucket count, and Newton's sums are added up over the
tasks.  The quantile is the exact one of all of them.  Every document is scored
in one vectorized pass over its whole text.

Defined results: a null or empty text has zero features and a score; of several
labels for one document the lowest counts; without labels of both kinds every
score is 0.5; repeated rows count each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .quality_rules import measure
from .storage import bounded_batches, discard, materialize, whole_runs

_PUNCTUATION = re.compile(r"[!?.,;:]")
_DIGITS = re.compile(r"[0-9]")
N_FEATURES = 11


@dataclass(frozen=True)
class QualitySettings:
    #: Rows of the more frequent label in a bucket, and at least about so many of the other.
    bucket_rows: int = 256
    bucket_others: int = 16
    l2: float = 1e-3
    steps: int = 40
    threshold: float = 0.3


def features(text: str | None) -> list[float]:
    """Numbers that describe the form of a whole text."""
    n, chars, symbols, dup_lines, repeats, lines, upper = measure(text)
    if not n:
        return [0.0] * N_FEATURES
    words = text.split()
    return [
        min(1.0, np.log1p(n) / 10),
        min(1.0, chars / n / 20),
        min(1.0, symbols / n),
        dup_lines / max(lines, 1),
        repeats / n,
        upper / max(chars, 1),
        min(1.0, len(_PUNCTUATION.findall(text)) / n / 2),
        len(_DIGITS.findall(text)) / max(chars, 1),
        len(set(words)) / max(len(words), 1),
        min(1.0, lines / n * 5),
        1.0 if repeats > n / 2 else 0.0,
    ]


@dataclass(frozen=True)
class Ranking:
    weights: np.ndarray
    #: The score of the threshold quantile.
    cut: float
    threshold: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; ``threshold`` falls on the quantile."""
        at = x @ self.weights - self.cut + np.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip(at, -30, 30)))


def _bucketed(rows: DataFrame, counts: dict[int, int], s: QualitySettings) -> DataFrame:
    """bucket, label and x, where every bucket has rows of both labels.

    A row of the rarer label goes to several buckets where it must.
    """
    rare = min(counts, key=counts.get)
    buckets = max(1, max(counts.values()) // s.bucket_rows)
    h = F.xxhash64("x", F.lit(5))
    while True:
        copies = min(buckets, -(-s.bucket_others * buckets // counts[rare]))
        turn = F.explode(F.when(F.col("label") == rare, F.sequence(F.lit(0), F.lit(copies - 1))).otherwise(F.array(F.lit(0))))
        dealt = rows.select("label", "x", turn.alias("turn")).select(F.pmod(h + F.col("turn") * (buckets // copies), F.lit(buckets)).alias("bucket"), "label", "x")
        dealt = materialize(dealt.repartition("bucket").sortWithinPartitions("bucket", "label", "x"), "buckets")
        whole = dealt.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b"))
        if buckets == 1 or whole.where("a = b").isEmpty():
            return dealt
        discard(dealt)
        buckets = max(1, buckets // 2)


def _sums(dealt: DataFrame, w: np.ndarray) -> np.ndarray:
    """Number of pairs, gradient and Hessian of the logistic loss, over all pairs of each bucket."""
    k = len(w)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + k + k * k)
        for b in whole_runs(batches, 1):
            bucket, label = b.column(0).to_numpy(), b.column(1).to_numpy()
            x = b.column(2).flatten().to_numpy().reshape(len(label), k)
            starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))).tolist()
            for start, end in zip(starts, [*starts[1:], len(label)]):
                of, own = label[start:end], x[start:end]
                good, bad = own[of == 1], own[of == 0]
                step = max(1, (1 << 16) // max(1, len(good)))
                for i in range(0, len(bad) if len(good) else 0, step):
                    d = (good[:, None] - bad[None, i : i + step]).reshape(-1, k)
                    p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
                    total += np.concatenate(([len(d)], d.T @ p, ((d * (p * (1 - p))[:, None]).T @ d).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

    return np.sum(sorted(r.sums for r in dealt.mapInArrow(add, "sums array<double>").collect()), axis=0)


def order_statistic(scores: DataFrame, k: int) -> float:
    """The exact k-th smallest (from 0) of the column ``score``, by ranges of values."""
    low, high = scores.agg(F.min("score"), F.max("score")).first()
    while low < high:
        bin_of = F.least(F.lit(1023), F.floor((F.col("score") - low) / (high - low) * 1024))
        bins = scores.where(F.col("score").between(low, high)).groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
        for r in sorted(bins.collect()):
            if k < r.n:
                low, high = r.low, r.high
                break
            k -= r.n
    return low


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], names=["doc_id", "x"])


def train(docs: DataFrame, labels: DataFrame, learn: Column, s: QualitySettings = QualitySettings()) -> Ranking | None:
    """Fit on the labelled rows (doc_id, quality) for which ``learn`` holds, all of them."""
    bounded_batches(docs.sparkSession)
    known = labels.where(learn & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    # Features before the join, so that it moves no text.
    own = docs.select("doc_id", "text").where("doc_id is not null")
    rows = own.mapInArrow(_feature_batches, StructType([own.schema["doc_id"], StructField("x", ArrayType(DoubleType()))]))
    rows = materialize(rows.join(known, "doc_id").select("label", "x").distinct(), "quality")
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        discard(rows)
        return None
    dealt = _bucketed(rows, counts, s)
    w = np.zeros(N_FEATURES)
    for _ in range(s.steps):  # Newton steps on the logistic loss
        sums = _sums(dealt, w)
        gradient, hessian = sums[1 : N_FEATURES + 1] / sums[0], sums[N_FEATURES + 1 :].reshape(N_FEATURES, N_FEATURES) / sums[0]
        step = np.linalg.solve(hessian + s.l2 * np.eye(N_FEATURES), gradient - s.l2 * w)
        w += step
        if np.abs(step).max() < 1e-9 * max(1, np.abs(w).max()):
            break

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).flatten().to_numpy().reshape(b.num_rows, N_FEATURES)
            yield pa.RecordBatch.from_arrays([pa.array(x @ w)], names=["score"])

    scores = materialize(rows.select("x").mapInArrow(value, "score double"), "scores")
    k = counts[0]
    cut = (order_statistic(scores, k - 1) + order_statistic(scores, k)) / 2
    discard(rows, dealt, scores)
    return Ranking(w, float(cut), s.threshold)


def score(docs: DataFrame, ranking: Ranking | None, s: QualitySettings = QualitySettings(), keep: bool = False) -> DataFrame:
    """doc_id, score and predicted; with ``keep``, the rows of ``docs`` that are predicted 1."""
    bounded_batches(docs.sparkSession)

    def of(texts: list[str | None]) -> np.ndarray:
        if ranking is None:
            return np.full(len(texts), 0.5)
        return ranking.scores(np.array([features(t) for t in texts]).reshape(len(texts), N_FEATURES))

    if keep:
        at = docs.columns.index("text")

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(of(b.column(at).to_pylist()) >= s.threshold))

        return docs.mapInArrow(kept, docs.schema)
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = of(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= s.threshold).astype(np.int32))], schema=out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scored, "doc_id long, score double, predicted int")
