"""Queries on a built model, with rescorers and candidate filters."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import lsh, preferences, recommend, topk
from ..sources.models import factors_from_pmml, factors_to_pmml
from .generation import Generations


class NotReady(RuntimeError):
    pass


@dataclass(frozen=True)
class Rescorer:
    """A new score and a filter, as column functions of (id, value)."""

    rescore: Callable[[Column, Column], Column] = lambda i, v: v
    is_filtered: Callable[[Column], Column] = lambda i: F.lit(False)

    def __call__(self, scored: DataFrame) -> DataFrame:
        kept = scored.where(~self.is_filtered(F.col("item_id"))).withColumn("value", self.rescore(F.col("item_id"), F.col("value")))
        return kept.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))


@dataclass(frozen=True)
class PairRescorer:
    """A new score and a filter for pairs of items: (asked item, item, value)."""

    rescore: Callable[[Column, Column, Column], Column] = lambda a, i, v: v
    is_filtered: Callable[[Column, Column], Column] = lambda a, i: F.lit(False)

    def __call__(self, scored: DataFrame) -> DataFrame:
        """Of rows (asked, item_id, value)."""
        kept = scored.where(~self.is_filtered(F.col("asked"), F.col("item_id")))
        out = kept.withColumn("value", self.rescore(F.col("asked"), F.col("item_id"), F.col("value")))
        return out.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))


class RescorerProvider:
    """What makes rescorers for a kind of query from its string arguments; None for none."""

    def for_recommend(self, users: list[int], *args: str) -> Rescorer | None:
        return None

    def for_anonymous(self, items: list[int], *args: str) -> Rescorer | None:
        return None

    def for_most_popular(self, *args: str) -> Rescorer | None:
        return None

    def for_most_similar(self, *args: str) -> PairRescorer | None:
        return None


def load(name: str, *args):
    """An instance of ``package.module:Class`` (or a function's result)."""
    module, _, own = name.partition(":")
    return getattr(importlib.import_module(module), own)(*args)


def sign_candidates(y: DataFrame, ratio: float, hashes: int = 20) -> Callable[[DataFrame, list[float]], DataFrame]:
    """A candidate filter by sign bits: about ``ratio`` of the items of a vector, all from 1 on."""
    if ratio >= 1:
        return lambda items, vector: items
    size = len(y.first()["features"])
    index = lsh.SignIndex(y, size, hashes, ratio)
    return lambda items, vector: index.candidates(vector).drop("signature").join(items.select("item_id"), "item_id", "left_semi")


def chain(*rescorers: Rescorer) -> Rescorer:
    """One after the other; any filter filters."""

    def rescore(i: Column, v: Column) -> Column:
        for r in rescorers:
            v = r.rescore(i, v)
        return v

    def filtered(i: Column) -> Column:
        out = F.lit(False)
        for r in rescorers:
            out = out | r.is_filtered(i)
        return out

    return Rescorer(rescore, filtered)


@dataclass
class Recommender:
    """A model's factors and preferences; answers are DataFrames of (item_id, value).

    ``candidates`` may choose among the items for a vector (see
    ``sign_candidates``); ``candidate_filter`` among all of them.
    """

    x: DataFrame | None = None
    y: DataFrame | None = None
    r: DataFrame | None = None
    names: DataFrame | None = None
    candidate_filter: Callable[[DataFrame], DataFrame] = field(default=lambda df: df)
    candidates: Callable[[DataFrame, list[float]], DataFrame] | None = None
    provider: RescorerProvider = field(default_factory=RescorerProvider)
    read_only: bool = False
    #: Changes since the model was made, in order: (user, item, value or None for a removal).
    recent: list[tuple[int, int, float | None]] = field(default_factory=list)

    def ready(self) -> bool:
        return self.x is not None and self.y is not None

    def refresh(self, generations: Generations) -> bool:
        """Take the newest finished generation, then apply recent changes again."""
        newest = generations.newest_done()
        if newest is None:
            return False
        text = generations.store.read_text(f"{generations.name(newest)}/model.pmml")
        for name, path in factors_from_pmml(text).items():
            setattr(self, name, generations.spark.read.parquet(path))
        again, self.recent = self.recent, []
        for u, i, v in again:
            self.remove(u, i) if v is None else self.set_preference(u, i, v)
        return True

    def save(self, generations: Generations, generation: int) -> None:
        """Write the model's tables and their description to a generation."""
        tables = {k: v for k, v in (("x", self.x), ("y", self.y), ("r", self.r), ("names", self.names)) if v is not None}
        for name, table in tables.items():
            generations.table(generation, name, lambda table=table: table)
        paths = {k: generations.path(generation, k) for k in tables}
        generations.store.write_text(f"{generations.name(generation)}/model.pmml", factors_to_pmml(paths))

    def _id(self, name: str | int) -> int:
        if isinstance(name, int):
            return name
        spark = self.y.sparkSession
        return spark.range(1).select(ids.to_long(F.lit(name)).alias("i")).first()["i"]

    def _ids(self, names) -> list[int]:
        return [self._id(n) for n in names]

    def _items(self) -> DataFrame:
        if not self.ready():
            raise NotReady("no model is loaded")
        return self.candidate_filter(self.y)

    def _near(self, users: list[int]) -> DataFrame:
        """The items, or the candidates for the users' mean vector."""
        items = self._items()
        if self.candidates is None:
            return items
        found = [f["features"] for f in self.x.where(F.col("user_id").isin(users)).collect()]
        return self.candidates(items, [sum(v) / len(found) for v in zip(*found)]) if found else items

    def _named(self, df: DataFrame) -> DataFrame:
        return df if self.names is None else ids.decode(df, self.names, "item_id")

    def recommend(self, user, n: int = 10, consider_known: bool = False, rescorer: Rescorer | None = None, args: tuple[str, ...] = ()) -> DataFrame:
        self._items()
        u = self._id(user)
        return self._named(recommend.recommend(self.x, self._near([u]), self.r, u, n, consider_known, rescorer or self.provider.for_recommend([u], *args)))

    def recommend_to_many(self, users, n: int = 10, consider_known: bool = False, args: tuple[str, ...] = ()) -> DataFrame:
        self._items()
        own = self._ids(users)
        return self._named(recommend.recommend_to_many(self.x, self._near(own), self.r, own, n, consider_known, self.provider.for_recommend(own, *args)))

    def recommend_to_anonymous(self, items, values=None, n: int = 10, args: tuple[str, ...] = ()) -> DataFrame:
        y, own = self._items(), self._ids(items)
        return self._named(recommend.recommend_to_anonymous(y, own, values, n, self.provider.for_anonymous(own, *args)))

    def most_similar(self, items, n: int = 10, rescorer: PairRescorer | None = None, args: tuple[str, ...] = ()) -> DataFrame:
        return self._named(recommend.most_similar(self._items(), self._ids(items), n, rescorer or self.provider.for_most_similar(*args)))

    def similarity_to_item(self, to_item, items) -> DataFrame:
        return self._named(recommend.similarity_to_item(self._items(), self._id(to_item), self._ids(items)))

    def estimate(self, user, items) -> DataFrame:
        pairs = self._items().sparkSession.createDataFrame([(self._id(user), i) for i in self._ids(items)], "user_id long, item_id long")
        return self._named(recommend.estimates(pairs, self.x, self.y)).select("item_id", "value")

    def estimate_for_anonymous(self, to_item, items, values=None) -> DataFrame:
        return self._named(recommend.estimate_for_anonymous(self._items(), self._id(to_item), self._ids(items), values))

    def because(self, user, item, n: int = 10) -> DataFrame:
        pairs = self._items().sparkSession.createDataFrame([(self._id(user), self._id(item))], "user_id long, to_item long")
        return self._named(recommend.because(self.r, self.y, pairs, n).select("item_id", "value"))

    def most_popular(self, n: int = 10, args: tuple[str, ...] = ()) -> DataFrame:
        counted, rescorer = preferences.popularity(self.r), self.provider.for_most_popular(*args)
        return self._named(topk.top(rescorer(counted) if rescorer else counted, n))

    def _writable(self) -> None:
        self._items()
        if self.read_only:
            raise PermissionError("the model is read-only")

    def set_preference(self, user, item, value: float = 1.0) -> None:
        """Add a preference and move both vectors, at once; new ids start at zero."""
        from ..streaming import flows

        self._writable()
        u, i = self._id(user), self._id(item)
        xs, ys = flows.fold_in([(u, i, value)], self.x, self.y)
        self.x, self.y = flows.apply_vectors(self.x, "user_id", xs), flows.apply_vectors(self.y, "item_id", ys)
        one = self.r.sparkSession.createDataFrame([(u, i, float(value), False)], "user_id long, item_id long, value double, is_delete boolean")
        self.r = preferences.merge(self.r, one)
        self.recent.append((u, i, float(value)))

    def ingest(self, prefs: DataFrame, decay: float = 1.0) -> None:
        """Merge new preferences; factors follow with the next generation."""
        self._writable()
        self.r = preferences.merge(self.r, prefs, decay)

    def remove(self, user, item) -> None:
        """Forget a preference; a user without any loses its vector."""
        self._writable()
        u, i = self._id(user), self._id(item)
        self.r = self.r.where(~((F.col("user_id") == u) & (F.col("item_id") == i)))
        if self.r.where(F.col("user_id") == u).isEmpty():
            self.x = self.x.where(F.col("user_id") != u)
        self.recent.append((u, i, None))
