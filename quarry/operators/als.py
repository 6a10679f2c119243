"""Alternating least squares for implicit feedback, on DataFrames.

A half-step joins ratings with the other side's factors on the item, brings
each row's entries together sorted, and solves rows in a stream, where they are
and many at once: memory is some k×k systems, whatever a row's length.  The entries of a row with very many are
dealt to several tasks, whose partial systems are added up before it is solved.
YᵀY is one small matrix.
Each half-step is cut from its lineage by a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RecommenderSettings
from ..functions import vectors as V
from ..functions.random import gaussians
from ..plans.storage import TASK_ROWS, cut_lineage
from .blocks import gram, matrix


class SingularModel(ValueError):
    """The factors do not have full rank; ``rank`` is what they seem to have."""

    def __init__(self, rank: int, features: int):
        super().__init__(f"apparent rank {rank} of {features} features; use fewer features or a lower lambda")
        self.rank = rank


#: Numbers of the systems that a task holds at once, and the widest that are summed without a product each.
SYSTEM_NUMBERS, NARROW = 2_000_000, 16


def _weights(value: np.ndarray, s: RecommenderSettings) -> tuple[np.ndarray, np.ndarray]:
    """Of each entry, what its vector counts in the matrix and in the right-hand side."""
    if s.reconstruct_r:
        w, b = np.zeros(len(value)), value
    else:
        extra = s.alpha * np.abs(value)
        w, b = extra, np.where(value > 0, 1 + extra, 0.0)
    return (w + 1 if s.loss_ignores_unspecified else w), b


def normal_parts(value: np.ndarray, y: np.ndarray, s: RecommenderSettings) -> tuple[np.ndarray, np.ndarray]:
    """A row's additions to the system's matrix and right-hand side."""
    w, b = _weights(value, s)
    return (y * w[:, None]).T @ y, y.T @ b


def _systems(value: np.ndarray, y: np.ndarray, edges: np.ndarray, s: RecommenderSettings) -> tuple[np.ndarray, np.ndarray]:
    """``normal_parts`` of the rows between the edges, stacked."""
    k = y.shape[1]
    w, b = _weights(value, s)
    right = np.add.reduceat(y * b[:, None], edges[:-1])
    if k <= NARROW:
        i, j = np.tril_indices(k)
        low = np.add.reduceat((y[:, i] * w[:, None]) * y[:, j], edges[:-1])
        whole = np.empty((len(low), k, k))
        whole[:, i, j] = whole[:, j, i] = low
    else:
        heavy = y * w[:, None]
        whole = np.stack([heavy[x:z].T @ y[x:z] for x, z in zip(edges[:-1], edges[1:])])
    return whole, right


def hot_users(r: DataFrame, hot_rows: int = 200_000) -> DataFrame | None:
    """(user_id, held) of the users with more than ``hot_rows`` entries, or None; they are few, as each has so many."""
    found = r.groupBy("user_id").agg(F.count("*").alias("held")).where(F.col("held") > hot_rows).collect()
    return r.sparkSession.createDataFrame([(q["user_id"], q["held"]) for q in found], "user_id long, held long") if found else None


def normal_equations(r: DataFrame, y: DataFrame, s: RecommenderSettings, hot: DataFrame | None, finish, columns: str, rows: int = 0, hot_rows: int = 200_000) -> DataFrame:
    """What ``finish`` makes of every user's system, where it was added up.

    ``finish`` gets arrays of users, numbers of entries, k×k matrices and
    right-hand sides and returns the arrays of ``columns``, a schema.  A user
    of ``hot`` has several systems, to be added up.  ``rows`` says how many
    entries there are, where that is known.
    """
    spark = r.sparkSession
    names = [c.split()[0] for c in columns.split(", ")]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, whole, right = None, 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            users, value, f = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(float), matrix(batch.column(2))
            edges = np.concatenate(([0], np.flatnonzero(np.diff(users)) + 1, [len(users)]))
            step = max(1, SYSTEM_NUMBERS // f.shape[1] ** 2)
            for g in range(0, len(edges) - 1, step):
                cut = edges[g : g + step + 1]
                own, n = users[cut[:-1]], np.diff(cut)
                w, b = _systems(value[cut[0] : cut[-1]], f[cut[0] : cut[-1]], cut - cut[0], s)
                if now is not None and own[0] == now:
                    n[0], w[0], b[0] = n[0] + held, w[0] + whole, b[0] + right
                elif now is not None:
                    yield pa.RecordBatch.from_arrays(finish(np.array([now]), np.array([held]), whole[None], right[None]), names=names)
                if len(own) > 1:
                    yield pa.RecordBatch.from_arrays(finish(own[:-1], n[:-1], w[:-1], b[:-1]), names=names)
                now, held, whole, right = own[-1], n[-1], w[-1].copy(), b[-1].copy()
        if now is not None:
            yield pa.RecordBatch.from_arrays(finish(np.array([now]), np.array([held]), whole[None], right[None]), names=names)

    # A fixed number of tasks: small rows may be much work.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    entries = r.join(y, "item_id").where("features is not null")
    if hot is None:
        entries = entries.select("user_id", "value", "features").repartition(tasks, "user_id").sortWithinPartitions("user_id")
    else:
        part = F.when(F.col("held").isNotNull(), F.pmod(F.xxhash64("item_id"), F.ceil(F.col("held") / hot_rows))).otherwise(0).alias("part")
        entries = entries.join(F.broadcast(hot), "user_id", "left").select("user_id", "value", "features", part)
        entries = entries.repartition(tasks, "user_id", "part").sortWithinPartitions("user_id", "part")
    return entries.select("user_id", "value", "features").mapInArrow(add_up, columns)


def lists(rows: np.ndarray) -> pa.Array:
    """A matrix as an array of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.reshape(-1)))


def half_step(r: DataFrame, y: DataFrame, s: RecommenderSettings, hot_rows: int = 200_000, hot: DataFrame | None | str = "unknown", rows: int = 0) -> DataFrame:
    """(user_id, features) from ratings (user_id, item_id, value) and (item_id, features)."""
    if isinstance(hot, str):
        hot = hot_users(r, hot_rows)
    gramian = gram(y)
    k = len(gramian)
    base = np.zeros((k, k)) if s.loss_ignores_unspecified else gramian
    ridge = s.lambda_ * s.alpha

    def solve(users: np.ndarray, n: np.ndarray, w: np.ndarray, b: np.ndarray) -> list[pa.Array]:
        return [pa.array(users), lists(_all_solved(base, ridge, w, b, n))]

    def as_they_are(users: np.ndarray, n: np.ndarray, w: np.ndarray, b: np.ndarray) -> list[pa.Array]:
        return [pa.array(users), pa.array(n), lists(w.reshape(len(w), -1)), lists(b)]

    def solve_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = solve(batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2)).reshape(-1, k, k), matrix(batch.column(3)))
                yield pa.RecordBatch.from_arrays(found, names=["user_id", "features"])

    out = "user_id long, features array<float>"
    if hot is None:
        return normal_equations(r, y, s, None, solve, out, rows)
    # The partial systems of hot users are added up; all others are solved where they are.
    most = normal_equations(r.join(F.broadcast(hot.select("user_id")), "user_id", "left_anti"), y, s, None, solve, out, rows)
    parts = normal_equations(r.join(F.broadcast(hot.select("user_id")), "user_id", "left_semi"), y, s, hot, as_they_are, "user_id long, n long, w array<double>, b array<double>", rows, hot_rows)
    parts = cut_lineage(parts, "systems")
    cells = lambda c: parts.select("user_id", F.posexplode(c).alias("i", "v")).groupBy("user_id", "i").agg(F.sum("v").alias("v")).groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda z: z["v"]).alias(c))
    sizes = parts.groupBy("user_id").agg(F.sum("n").alias("n"))
    return most.union(sizes.join(cells("w"), "user_id").join(cells("b"), "user_id").select("user_id", "n", "w", "b").mapInArrow(solve_rows, out))


def _all_solved(base: np.ndarray, ridge: float, w: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The systems' solutions, all at once where none is singular."""
    a = base + w + ridge * n[:, None, None] * np.eye(b.shape[1])
    try:
        np.linalg.cholesky(a)
        return np.linalg.solve(a, b[:, :, None])[:, :, 0].astype(np.float32)
    except np.linalg.LinAlgError:
        return np.stack([_solved(base, ridge, *row) for row in zip(w, b, n)])


def _solved(base: np.ndarray, ridge: float, w: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The system's solution; of a singular one the shortest of the best."""
    a = base + w + ridge * n * np.eye(len(b))
    try:
        np.linalg.cholesky(a)
        return np.linalg.solve(a, b).astype(np.float32)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, b, rcond=1e-10)[0].astype(np.float32)


def initial_factors(ids: DataFrame, k: int, seed: int = 1729, previous: DataFrame | None = None) -> DataFrame:
    """Unit vectors by hash of the id; earlier ones are kept, cut or padded."""
    # The numbers are made once a row: inside an expression for the length they would be made for each element.
    fresh = ids.select("item_id").distinct().withColumn("_raw", gaussians(F.col("item_id"), k, seed))
    fresh = fresh.select("item_id", V.normalize(F.col("_raw")).alias("_new"))
    if previous is None:
        return fresh.select("item_id", F.col("_new").cast("array<float>").alias("features"))
    old = F.col("_old")
    same = F.when(F.size(old) == k, old).when(F.size(old) > k, V.normalize(F.slice(old, 1, k)))
    padded = V.normalize(F.concat(old, F.slice(F.col("_new"), F.size(old) + 1, k)))
    joined = fresh.join(previous.select("item_id", F.col("features").cast("array<double>").alias("_old")), "item_id", "left")
    return joined.select("item_id", F.coalesce(same, F.when(old.isNotNull(), padded), "_new").cast("array<float>").alias("features"))


def new_items(r: DataFrame) -> DataFrame:
    """(item_id, features): every item with an empty vector, to go beside earlier ones."""
    return r.select("item_id").distinct().select("item_id", F.array().cast("array<float>").alias("features"))


def first_vectors(*sources: DataFrame) -> DataFrame:
    """(item_id, features): of each item the longest of its vectors, so one that is not empty."""
    rows = sources[0].select("item_id", "features")
    for s in sources[1:]:
        rows = rows.unionByName(s.select("item_id", "features"))
    return rows.groupBy("item_id").agg(F.max_by("features", F.size("features")).alias("features"))


def sampled(pairs: DataFrame, modulus: int) -> DataFrame:
    """The rows whose user and item ids are both multiples of the modulus."""
    return pairs.where((F.col("user_id") % modulus == 0) & (F.col("item_id") % modulus == 0))


def convergence(old: DataFrame, new: DataFrame) -> DataFrame:
    """Mean of abs(new - old) weighted by new, over pairs where new > 0."""
    both = old.select("user_id", "item_id", F.col("value").alias("old")).join(new, ["user_id", "item_id"])
    positive = both.where("value > 0")
    return positive.agg(F.try_divide(F.sum(F.abs(F.col("value") - F.col("old")) * F.col("value")), F.sum("value")).alias("change"))


def _sampled_scores(x: DataFrame, y: DataFrame, users: list[int], items: list[int]) -> np.ndarray:
    u = {r["user_id"]: r["features"] for r in x.where(F.col("user_id").isin(users)).collect()}
    i = {r["item_id"]: r["features"] for r in y.where(F.col("item_id").isin(items)).collect()}
    return np.array([u[a] for a in users if a in u], float) @ np.array([i[b] for b in items if b in i], float).T


def factorize(r: DataFrame, s: RecommenderSettings = RecommenderSettings(), y0: DataFrame | None = None, seed: int = 1729) -> tuple[DataFrame, DataFrame, int]:
    """X, Y and the iterations run; stops when sampled scores settle."""
    r = cut_lineage(r.select("user_id", "item_id", "value"), "ratings")
    y = y0 if y0 is not None else cut_lineage(initial_factors(r, s.features, seed), "y")
    sample = lambda c: [x[0] for x in r.select(c).distinct().orderBy(F.xxhash64(c), c).limit(100).collect()]
    users, items = sample("user_id"), sample("item_id")
    turned = r.select(F.col("item_id").alias("user_id"), F.col("user_id").alias("item_id"), "value")
    rows, hot, hot_turned = r.count(), hot_users(r), hot_users(turned)
    before, x, done = None, None, 0
    for done in range(1, s.max_iterations + 1):
        x = cut_lineage(half_step(r, y, s, hot=hot, rows=rows), "x")
        y = cut_lineage(half_step(turned, x.withColumnRenamed("user_id", "item_id"), s, hot=hot_turned, rows=rows).withColumnRenamed("user_id", "item_id"), "y")
        now = _sampled_scores(x, y, users, items)
        if not np.isfinite(now).all():
            break
        if before is not None and (done > 2 or y0 is not None):
            good = now > 0
            if good.any() and np.average(np.abs(now - before)[good], weights=now[good]) < s.convergence_threshold:
                break
        before = now
    return x, y, done


def check_rank(*factors: DataFrame, threshold: float = 1e-5) -> None:
    """Raise where XᵀX or YᵀY is singular."""
    for f in factors:
        g = gram(f)
        if len(g) and (rank := int(np.linalg.matrix_rank(g, tol=threshold * max(1.0, np.abs(g).max())))) < len(g):
            raise SingularModel(rank, len(g))
