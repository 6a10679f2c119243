"""Clustering with automatic choice of K, through a weighted sketch.

Points meet the centres as a small broadcast matrix; a centre set's size is a
setting, never the data's.  The sketch (a few hundred weighted points for each
fold) is what the expensive choices run on, so replications and Ks cost the
same at any scale.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ClusterSettings
from ..functions import vectors as V
from ..functions.random import fold
from ..plans.storage import cut_lineage
from .blocks import matrix
from .sampling import first_per_fold, weighted_sample


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared, by differences (exact ties stay ties), a few centres at a time."""
    return np.stack([((x - c) ** 2).sum(1) for c in centers], 1)


def assign(points: DataFrame, centers: np.ndarray | list, vec: str = "vec") -> DataFrame:
    """Adds center_id and sq, the nearest centre; the lowest id wins ties."""
    c = np.asarray(centers, float)
    schema = T.StructType([*points.schema, T.StructField("center_id", T.IntegerType()), T.StructField("sq", T.DoubleType())])
    at = points.columns.index(vec)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = distances(matrix(b.column(at)), c)
                best = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best.astype(np.int32)), pa.array(d[np.arange(len(d)), best])], names=[*b.schema.names, "center_id", "sq"])

    return points.mapInArrow(nearest, schema)


def centroids(assigned: DataFrame, size: int, vec: str = "vec", weight: Column | None = None) -> DataFrame:
    """(center_id, n, centroid): weighted means with partial sums."""
    w = F.lit(1.0) if weight is None else weight
    return assigned.groupBy("center_id").agg(F.sum(w).alias("n"), F.array(*(F.sum(F.col(vec)[i] * w) / F.sum(w) for i in range(size))).alias("centroid"))


def lloyd_many(points: DataFrame, models: list[list[list[float]]], iterations: int = 1, vec: str = "vec") -> list[list[list[float]]]:
    """Lloyd steps of several centre sets, each step one pass over the points.

    A task adds up sums for its points; what is shuffled has a row for each
    centre, element and task.
    """
    now = [np.asarray(m, float) for m in models]
    for _ in range(iterations):

        def part(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            sums = [np.zeros((len(m), m.shape[1] + 1)) for m in now]
            for b in batches:
                x = matrix(b.column(0))
                for k, m in enumerate(now if len(x) else []):
                    near = distances(x, m).argmin(1)
                    np.add.at(sums[k], near, np.column_stack([np.ones(len(x)), x]))
            for k, total in enumerate(sums):
                c, e = np.nonzero(np.ones_like(total))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), k)), pa.array(c), pa.array(e), pa.array(total.reshape(-1))], names=["model", "center", "e", "v"])

        rows = points.select(vec).where(F.col(vec).isNotNull()).mapInArrow(part, "model long, center long, e long, v double").groupBy("model", "center", "e").agg(F.sum("v").alias("v")).collect()
        totals = [np.zeros((len(m), m.shape[1] + 1)) for m in now]
        for r in rows:
            totals[r["model"]][r["center"], r["e"]] = r["v"]
        now = [np.where(t[:, :1] > 0, t[:, 1:] / np.maximum(t[:, :1], 1), m) for t, m in zip(totals, now)]
    return [m.tolist() for m in now]


class CenterIndex:
    """Nearest centres of several models through sign bits of random planes.

    The centres with the ``shortlist`` smallest Hamming distances are compared
    exactly, by squared lengths and products; ``exact`` compares all.
    """

    def __init__(self, models: list, bits: int = 64, shortlist: int = 10, seed: int = 1729):
        self.centers = [np.asarray(m, float) for m in models]
        size = self.centers[0].shape[1]
        self.planes = np.random.default_rng(seed).normal(size=(size, bits))
        self.signs = [m @ self.planes > 0 for m in self.centers]
        self.squares = [(m * m).sum(1) for m in self.centers]
        self.shortlist = shortlist

    def nearest(self, x: np.ndarray, model: int, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Centre ids and squared distances of the rows of ``x``."""
        c, own = self.centers[model], (x * x).sum(1)
        if exact or len(c) <= self.shortlist:
            d = own[:, None] + self.squares[model] - 2 * x @ c.T
            best = d.argmin(1)
            return best, np.maximum(d[np.arange(len(x)), best], 0)
        away = ((x @ self.planes > 0)[:, None, :] != self.signs[model]).sum(2)
        some = np.argsort(away, axis=1, kind="stable")[:, : self.shortlist]
        d = own[:, None] + self.squares[model][some] - 2 * np.einsum("nd,nkd->nk", x, c[some])
        at = d.argmin(1)
        rows = np.arange(len(x))
        return some[rows, at], np.maximum(d[rows, at], 0)

    def assign(self, points: DataFrame, model: int = 0, exact: bool = False, vec: str = "vec") -> DataFrame:
        """Adds center_id and sq of one model."""
        schema = T.StructType([*points.schema, T.StructField("center_id", T.IntegerType()), T.StructField("sq", T.DoubleType())])
        at = points.columns.index(vec)

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    best, sq = self.nearest(matrix(b.column(at)), model, exact)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best.astype(np.int32)), pa.array(sq)], names=[*b.schema.names, "center_id", "sq"])

        return points.mapInArrow(near, schema)


def lloyd(points: DataFrame, centers: list[list[float]], iterations: int = 1, vec: str = "vec") -> list[list[float]]:
    """Distributed Lloyd steps; a centre without points stays."""
    now = [list(map(float, c)) for c in centers]
    for _ in range(iterations):
        for r in centroids(assign(points, now, vec), len(now[0]), vec).collect():  # k rows
            now[r["center_id"]] = list(r["centroid"])
    return now


def choose_random(x: np.ndarray, w: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    with np.errstate(divide="ignore"):
        key = np.where(w > 0, np.log(np.maximum(rng.random(len(x)), 1e-300)) / np.maximum(w, 1e-300), -np.inf)
    return x[np.argsort(-key, kind="stable")[:k]]


def choose_plus_plus(x: np.ndarray, w: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++: the next centre with probability w·d²."""
    out = [x[rng.choice(len(x), p=w / w.sum())]]
    d = ((x - out[0]) ** 2).sum(1)
    while len(out) < k and (w * d).sum() > 0:
        out.append(x[rng.choice(len(x), p=w * d / (w * d).sum())])
        d = np.minimum(d, ((x - out[-1]) ** 2).sum(1))
    return np.array(out)


def update_lloyd(x: np.ndarray, w: np.ndarray, centers: np.ndarray, iterations: int) -> np.ndarray:
    c = centers.copy()
    for _ in range(iterations):
        near = distances(x, c).argmin(1)
        for j in range(len(c)):
            mine = near == j
            if w[mine].sum() > 0:
                c[j] = np.average(x[mine], axis=0, weights=w[mine])
    return c


def update_minibatch(x: np.ndarray, w: np.ndarray, centers: np.ndarray, iterations: int, size: int, rng: np.random.Generator) -> np.ndarray:
    """Points drawn by weight; a centre moves by 1/(its count + 1)."""
    c, seen = centers.copy(), np.zeros(len(centers))
    for _ in range(iterations):
        batch = x[rng.choice(len(x), size=size, p=w / w.sum())]
        for p, j in zip(batch, distances(batch, c).argmin(1)):
            seen[j] += 1
            c[j] += (p - c[j]) / (seen[j] + 1)
    return c


def cluster(x: np.ndarray, w: np.ndarray, k: int, s: ClusterSettings, seed: int) -> np.ndarray:
    """Centres for a weighted sketch by the chosen strategies."""
    rng = np.random.default_rng(seed)
    start = (choose_plus_plus if s.init == "plus_plus" else choose_random)(x, w, k, rng)
    if s.update == "minibatch":
        return update_minibatch(x, w, start, s.iterations, s.minibatch_size, rng)
    return update_lloyd(x, w, start, s.iterations)


@dataclass(frozen=True)
class Validity:
    """How alike two clusterings of the same points are, and what they cost."""

    k: int
    replica: int
    test_cost: float
    train_cost: float
    van_dongen: float
    variation_of_information: float

    @property
    def cost(self) -> float:
        return self.test_cost + self.train_cost


def agreement(table: np.ndarray) -> tuple[float, float]:
    """Normalized Van Dongen and variation of information of a contingency table."""
    n = table.sum()
    rows, cols = table.sum(1), table.sum(0)
    low = 2 * n - rows.max() - cols.max()
    vd = (2 * n - table.max(1).sum() - table.max(0).sum()) / low if low > 0 else float("nan")
    ent = lambda c: float(np.sum([-v / n * np.log(v / n) for v in c if v > 0]))
    p = table / n
    outer = np.outer(rows, cols) / n / n
    mutual = float((p[p > 0] * np.log(p[p > 0] / outer[p > 0])).sum())
    total = ent(rows) + ent(cols)
    return vd, (1 - 2 * mutual / total if total > 0 else float("nan"))


def validity(x: np.ndarray, w: np.ndarray, test: np.ndarray, train: np.ndarray, k: int, replica: int) -> Validity:
    a, b = distances(x, test), distances(x, train)
    table = np.zeros((len(test), len(train)))
    np.add.at(table, (a.argmin(1), b.argmin(1)), w)
    return Validity(k, replica, float((w * a.min(1)).sum()), float((w * b.min(1)).sum()), *agreement(table))


def choose_k(stats: list[Validity], s: ClusterSettings) -> list[Validity]:
    """The cheapest at the fixed K, or among stable ones; all where none is."""
    if s.evaluate == "fixed":
        own = [v for v in stats if v.k == s.fixed_k]
    else:
        own = [v for v in stats if v.k != 1 and (v.variation_of_information < s.threshold or v.van_dongen < s.threshold)]
    return [min(own, key=lambda v: (v.cost, v.k, v.replica))] if own else stats


def sketch(points: DataFrame, s: ClusterSettings, key: str, vec: str = "vec") -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Weighted points for each fold, drawn by squared distance in rounds."""
    folded = points.select(key, vec, fold(F.col(key), s.folds, s.seed).alias("fold"))
    have: dict[int, list] = {r["fold"]: [r[vec]] for r in first_per_fold(folded, key).collect()}
    for i in range(s.sketch_iterations):
        parts = []
        for f, own in have.items():
            near = assign(folded.where(F.col("fold") == f), own, vec).where("sq > 0")
            parts.append(weighted_sample(near, s.sketch_points, key, "sq", seed=s.seed + i).select("fold", vec))
        for p in parts:
            for r in p.collect():  # at most sketch_points rows
                have[r["fold"]].append(r[vec])
    out = {}
    for f, own in have.items():
        counts = dict(assign(folded.where(F.col("fold") == f), own, vec).groupBy("center_id").count().collect())
        out[f] = (np.array(own, float), np.array([counts.get(j, 0) for j in range(len(own))], float))
    return out


def select_k(points: DataFrame, s: ClusterSettings = ClusterSettings(), key: str = "id", vec: str = "vec") -> tuple[list[Validity], list[Validity], dict[tuple[int, int], np.ndarray]]:
    """All statistics, the chosen ones, and centres by (k, replica)."""
    points = cut_lineage(points.select(key, vec), "points")
    folds = sketch(points, s, key, vec)
    (x0, w0), (x1, w1) = folds[0], folds[1 % len(folds)]
    grid = [(k, r) for k in s.ks for r in range(1 if k == 1 else s.replications)]
    jobs = points.sparkSession.createDataFrame(grid, "k int, replica int").repartition(max(1, len(grid)), "k", "replica")

    def one(batches):
        for b in batches:
            for k, r in zip(b["k"], b["replica"]):
                seed = int(r) + 31 * int(k)
                a, c = cluster(x0, w0, int(k), s, seed), cluster(x1, w1, int(k), s, seed)
                v0, v1 = validity(x1, w1, a, c, int(k), int(r)), validity(x0, w0, a, c, int(k), int(r))
                best = a if v0.test_cost + v1.test_cost <= v0.train_cost + v1.train_cost else c
                import pandas as pd

                yield pd.DataFrame([{"k": k, "replica": r, "test_cost": v0.test_cost, "train_cost": v0.train_cost, "vd": v0.van_dongen, "vi": v0.variation_of_information, "centers": best.tolist()}])

    rows = jobs.mapInPandas(one, "k int, replica int, test_cost double, train_cost double, vd double, vi double, centers array<array<double>>").collect()
    stats = sorted((Validity(r["k"], r["replica"], r["test_cost"], r["train_cost"], r["vd"], r["vi"]) for r in rows), key=lambda v: (v.k, v.replica))
    return stats, choose_k(stats, s), {(r["k"], r["replica"]): np.array(r["centers"]) for r in rows}


def result_tables(spark, stats: list[Validity], chosen: list[Validity], centers: dict[tuple[int, int], np.ndarray]):
    """(k, replica, costs, agreement, chosen) and (k, replica, center_id, center) of every model."""
    picked = {(v.k, v.replica) for v in chosen}
    rows = [(v.k, v.replica, v.test_cost, v.train_cost, v.van_dongen, v.variation_of_information, (v.k, v.replica) in picked) for v in stats]
    cells = [(k, r, i, c.tolist()) for (k, r), m in centers.items() for i, c in enumerate(m)]
    return (
        spark.createDataFrame(rows, "k int, replica int, test_cost double, train_cost double, van_dongen double, variation_of_information double, chosen boolean"),
        spark.createDataFrame(cells, "k int, replica int, center_id int, center array<double>"),
    )


def covariance(assigned: DataFrame, size: int, vec: str = "vec") -> DataFrame:
    """(center_id, i, j, mean_i, mean_j, cov), i <= j: population covariances.

    Every task adds up its own products, about one row of the data so that far
    means lose no digits; only size² numbers a cluster and task are shuffled.
    """
    some = assigned.select(vec).where(F.col(vec).isNotNull()).first()
    shift = np.array(some[0], float) if some else np.zeros(size)
    i, j = np.triu_indices(size)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            if not b.num_rows:
                continue
            ids, x = b.column(0).to_numpy(zero_copy_only=False), matrix(b.column(1)) - shift
            for k in np.unique(ids).tolist():
                own = x[ids == k]
                now = sums.setdefault(k, [0, np.zeros(size), np.zeros((size, size))])
                now[0] += len(own)
                now[1] += own.sum(0)
                now[2] += own.T @ own
        for k, (n, total, products) in sums.items():
            full = len(i)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(full, k, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.full(full, float(n))), pa.array(total[i]), pa.array(total[j]), pa.array(products[i, j])], names=["center_id", "i", "j", "n", "si", "sj", "q"])

    sums = assigned.select("center_id", vec).where(F.col(vec).isNotNull()).mapInArrow(part, "center_id int, i int, j int, n double, si double, sj double, q double")
    sums = sums.groupBy("center_id", "i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "si", "sj", "q")))
    origin = F.array(*map(F.lit, shift.tolist()))
    mean = lambda c, at: origin[F.col(at)] + F.col(c) / F.col("n")
    return sums.select("center_id", "i", "j", mean("si", "i").alias("mean_i"), mean("sj", "j").alias("mean_j"), (F.col("q") / F.col("n") - F.col("si") / F.col("n") * F.col("sj") / F.col("n")).alias("cov"))


def outliers(assigned: DataFrame, cells: DataFrame, size: int, vec: str = "vec") -> DataFrame:
    """Adds euclidean and mahalanobis (both squared) to the cluster's mean.

    -1 where a cluster has no covariance.  The cells are d² numbers a cluster.
    """
    means: dict[int, np.ndarray] = {}
    covs: dict[int, np.ndarray] = {}
    for r in cells.collect():
        m, c = means.setdefault(r["center_id"], np.zeros(size)), covs.setdefault(r["center_id"], np.zeros((size, size)))
        m[r["i"]], m[r["j"]] = r["mean_i"], r["mean_j"]
        c[r["i"], r["j"]] = c[r["j"], r["i"]] = r["cov"]
    inverse = {k: np.linalg.pinv(c) for k, c in covs.items()}
    schema = T.StructType([*assigned.schema, T.StructField("euclidean", T.DoubleType()), T.StructField("mahalanobis", T.DoubleType())])
    at, of = assigned.columns.index(vec), assigned.columns.index("center_id")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, ids = matrix(b.column(at)), b.column(of).to_numpy(zero_copy_only=False)
            e, m = np.full(len(ids), -1.0), np.full(len(ids), -1.0)
            for k, inv in inverse.items():
                mine = ids == k
                if mine.any():
                    d = x[mine] - means[k]
                    e[mine], m[mine] = (d * d).sum(1), np.einsum("ni,ij,nj->n", d, inv, d)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(e), pa.array(m)], names=[*b.schema.names, "euclidean", "mahalanobis"])

    return assigned.mapInArrow(score, schema)
