"""Recommender queries as DataFrames: set-based, a single user is one row."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..plans.storage import cut_lineage
from .blocks import best_pairs, gram
from .preferences import known_items
from .topk import top, top_per_group

#: Numbers of items' vectors that are broadcast at once.
BROADCAST_NUMBERS = 32_000_000


class NoSuchUser(LookupError):
    pass


class NoSuchItem(LookupError):
    pass


def recommend_all(x: DataFrame, y: DataFrame, r: DataFrame | None, n: int = 10) -> DataFrame:
    """(user_id, item_id, value): for every user the n best items it does not know."""
    users = x if r is None else x.join(known_items(r).withColumnRenamed("items", "known"), "user_id", "left")
    return best_pairs(users, y, n)


def similar_items(y: DataFrame, n: int = 10) -> DataFrame:
    """(user_id, item_id, value): for every item the n nearest by cosine."""
    return best_pairs(y.withColumnRenamed("item_id", "user_id"), y, n, cosine=True, exclude_self=True)


def fold_in_weight(estimate: Column, value: Column) -> Column:
    """How far an event moves a vector, given the present estimate."""
    up = (1 - 1 / (1 + value)) * (1 - F.greatest(F.lit(0.0), estimate))
    down = (1 - 1 / (1 - value)) * -F.least(F.lit(1.0), estimate)
    return F.when((value > 0) & (estimate < 1), up).when((value < 0) & (estimate > 0), down).otherwise(0.0)


def fold_in_weight_of(estimate: float, value: float) -> float:
    if value > 0 and estimate < 1:
        return (1 - 1 / (1 + value)) * (1 - max(0.0, estimate))
    if value < 0 and estimate > 0:
        return (1 - 1 / (1 - value)) * -min(1.0, estimate)
    return 0.0


def _found(df: DataFrame, key: str, ids: list[int]) -> list:
    return df.where(F.col(key).isin(ids)).collect()


def score_by(y: DataFrame, vector: list[float], value: str = "value") -> DataFrame:
    return y.select("item_id", V.dot(F.col("features"), F.array(*(F.lit(float(v)) for v in vector))).alias(value))


def recommend(x: DataFrame, y: DataFrame, r: DataFrame, user: int, n: int = 10, consider_known: bool = False, rescore=None) -> DataFrame:
    """(item_id, value) for one user; NoSuchUser where it has no vector."""
    found = _found(x, "user_id", [user])
    if not found:
        raise NoSuchUser(user)
    candidates = y if consider_known else y.join(r.where(F.col("user_id") == user).select("item_id"), "item_id", "left_anti")
    scored = score_by(candidates, found[0]["features"])
    return top(rescore(scored) if rescore else scored, n)


def recommend_to_many(x: DataFrame, y: DataFrame, r: DataFrame, users: list[int], n: int = 10, consider_known: bool = False, rescore=None) -> DataFrame:
    """Mean score over the users that exist, without items known to all of them."""
    from .preferences import known_to_all

    found = _found(x, "user_id", users)
    if not found:
        raise NoSuchUser(users)
    mean = np.mean([f["features"] for f in found], 0).tolist()
    candidates = y if consider_known else y.join(known_to_all(r, [f["user_id"] for f in found]), "item_id", "left_anti")
    scored = score_by(candidates, mean)
    return top(rescore(scored) if rescore else scored, n)


def anonymous_vector(y: DataFrame, items: list[int], values: list[float] | None = None) -> list[float]:
    """A user's vector from a few items, by one solve with YᵀY."""
    strength = dict(zip(items, values or [1.0] * len(items)))
    found = _found(y, "item_id", items)
    if not found:
        raise NoSuchItem(items)
    right = sum(fold_in_weight_of(0.0, strength[f["item_id"]]) * np.array(f["features"], float) for f in found)
    return _solution(gram(y), right).tolist()


def recommend_to_anonymous(y: DataFrame, items: list[int], values: list[float] | None = None, n: int = 10, rescore=None) -> DataFrame:
    scored = score_by(y.where(~F.col("item_id").isin(items)), anonymous_vector(y, items, values))
    return top(rescore(scored) if rescore else scored, n)


def estimate_for_anonymous(y: DataFrame, to_item: int, items: list[int], values: list[float] | None = None) -> DataFrame:
    return score_by(y.where(F.col("item_id") == to_item), anonymous_vector(y, items, values))


def estimates(pairs: DataFrame, x: DataFrame, y: DataFrame) -> DataFrame:
    """(user_id, item_id, value): 0 where the user or the item is unknown.

    Items' vectors are broadcast, in blocks of bounded size, so that no vector
    goes with its pairs to another task; users' vectors go once a block.
    """
    n, width = y.agg(F.count("*"), F.max(F.size("features"))).first()
    blocks = max(1, -(-n * max(1, width or 1) // BROADCAST_NUMBERS))
    if blocks > 1:
        pairs = cut_lineage(pairs, "pairs")
    parts = [estimates_of(pairs, x, y, blocks, k) for k in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def estimates_of(pairs: DataFrame, x: DataFrame, y: DataFrame, blocks: int, k: int) -> DataFrame:
    own = (lambda df: df) if blocks == 1 else lambda df: df.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
    items = F.broadcast(own(y).withColumnRenamed("features", "_y"))
    joined = own(pairs).join(x.withColumnRenamed("features", "_x"), "user_id", "left").join(items, "item_id", "left")
    return joined.select(*pairs.columns, F.coalesce(V.dot(F.col("_x"), F.col("_y")), F.lit(0.0)).alias("value"))


def most_similar(y: DataFrame, items: list[int], n: int = 10, rescore=None) -> DataFrame:
    """Mean cosine to the items that exist; they are left out.

    With ``rescore`` every pair's cosine is rescored before the mean.
    """
    found = _found(y, "item_id", items)
    if not found:
        raise NoSuchItem(items)
    unit = [np.array(f["features"], float) for f in found]
    unit = [u / max(np.linalg.norm(u), 1e-300) for u in unit]
    others = y.where(~F.col("item_id").isin(items)).select("item_id", V.normalize(F.col("features")).alias("_v"))
    if rescore is None:
        scored = others.select("item_id", V.dot(F.col("_v"), F.array(*map(F.lit, np.mean(unit, 0).tolist()))).alias("value"))
    else:
        pairs = [F.struct(F.lit(f["item_id"]).alias("asked"), V.dot(F.col("_v"), F.array(*map(F.lit, u.tolist()))).alias("value")) for f, u in zip(found, unit)]
        scored = rescore(others.select("item_id", F.inline(F.array(*pairs)))).groupBy("item_id").agg(F.avg("value").alias("value"))
    return top(scored.where(~F.isnan("value")), n)


def similarity_to_item(y: DataFrame, to_item: int, items: list[int]) -> DataFrame:
    """(item_id, value) for each asked item, NULL where it is missing."""
    found = _found(y, "item_id", [to_item])
    if not found:
        raise NoSuchItem(to_item)
    asked = y.sparkSession.createDataFrame([(i,) for i in items], "item_id long")
    target = F.array(*(F.lit(float(v)) for v in found[0]["features"]))
    return asked.join(y, "item_id", "left").select("item_id", V.cosine(F.col("features"), target).alias("value"))


def because(r: DataFrame, y: DataFrame, pairs: DataFrame, n: int = 10) -> DataFrame:
    """(user_id, to_item, item_id, value): known items nearest to each asked item."""
    target = y.select(F.col("item_id").alias("to_item"), F.col("features").alias("_to"))
    known = r.select("user_id", "item_id").distinct().join(pairs, "user_id").where("item_id <> to_item")
    scored = known.join(target, "to_item").join(y, "item_id").select("user_id", "to_item", "item_id", V.cosine(F.col("features"), F.col("_to")).alias("value"))
    return top_per_group(scored.where("value is not null"), n, ["user_id", "to_item"])


def updated_vectors(x: list[float], y: list[float], value: float, xtx: np.ndarray, yty: np.ndarray) -> tuple[list[float], list[float]]:
    """Both vectors after one event; both moves use the vectors before it."""
    a, b = np.array(x, float), np.array(y, float)
    w = fold_in_weight_of(float(a @ b), value)
    return (a + w * _solution(yty, b)).tolist(), (b + w * _solution(xtx, a)).tolist()


def _solution(m: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of a singular matrix the shortest of the best."""
    try:
        return np.linalg.solve(m, right)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(m, right, rcond=1e-10)[0]
