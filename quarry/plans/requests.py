"""Requests as paths, answered by DataFrames or rows: the query surface without HTTP.

``Requests`` has the routes of a recommender, ``ClusterRequests`` those of a
clustering and ``ForestRequests`` those of a forest.  Path parts are separated
by ``/`` and may be percent-encoded; ``status`` says what an error means.
"""

from __future__ import annotations

import csv
from collections.abc import Callable
from urllib.parse import parse_qs, unquote

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import encode_delimited
from ..operators import clustering, preferences
from ..operators.forest import Forest
from ..operators.recommend import NoSuchItem, NoSuchUser
from .serving import NotReady, Recommender
from .vectors import RowVectors


class BadRequest(ValueError):
    pass


class NoSuchRoute(LookupError):
    pass


#: What an error means to a caller.
STATUS = {BadRequest: 400, NoSuchRoute: 404, NoSuchUser: 404, NoSuchItem: 404, PermissionError: 405, NotReady: 503}


def status(error: Exception) -> int:
    return next((code for kind, code in STATUS.items() if isinstance(error, kind)), 500)


def lines(answer: DataFrame) -> DataFrame:
    """Answers as ``id,value`` lines."""
    return answer.select(encode_delimited([F.col(c) for c in answer.columns]).alias("line"))


def _number(text: str) -> float:
    try:
        return float(text)
    except ValueError:
        raise BadRequest(f"not a number: {text}") from None


def _weighted(parts: list[str]) -> tuple[list[str], list[float]]:
    """``item`` or ``item=value`` parts; the value is 1 by default."""
    split = [p.rpartition("=") if "=" in p else (p, "", "1") for p in parts]
    return [s[0] for s in split], [_number(s[2]) for s in split]


class _Routes:
    def routes(self) -> dict[tuple[str, str], Callable]:
        raise NotImplementedError

    def handle(self, method: str, path: str, body: str = ""):
        """The answer to a request such as ``GET /recommend/u1?howMany=3``."""
        path, _, query = path.partition("?")
        name, *parts = [unquote(p) for p in path.strip("/").split("/")]
        route = self.routes().get((method, name))
        if route is None:
            raise NoSuchRoute(f"{method} /{name}")
        return route(parts, parse_qs(query), body)


class Requests(_Routes):
    """A recommender's requests; ids that look like numbers are numbers."""

    def __init__(self, model: Recommender):
        self.model = model

    @staticmethod
    def _id(part: str):
        return int(part) if part.lstrip("-").isdigit() and len(part) < 19 else part

    @staticmethod
    def _at_least(parts: list[str], n: int, most: int | None = None) -> None:
        if len(parts) < n or (most is not None and len(parts) > most) or not all(parts):
            raise BadRequest("wrong number of path parts")

    @staticmethod
    def _options(params: dict) -> dict:
        n = _number(params.get("howMany", ["10"])[0])
        if n < 1 or n != int(n):
            raise BadRequest("howMany must be a positive whole number")
        return {"n": int(n), "args": tuple(params.get("rescorerParams", []))}

    def _known(self, params: dict) -> bool:
        return params.get("considerKnownItems", ["false"])[0].lower() == "true"

    def recommend(self, parts, params, body):
        self._at_least(parts, 1, 1)
        return self.model.recommend(self._id(parts[0]), consider_known=self._known(params), **self._options(params))

    def recommend_to_many(self, parts, params, body):
        self._at_least(parts, 1)
        return self.model.recommend_to_many([self._id(p) for p in parts], consider_known=self._known(params), **self._options(params))

    def recommend_to_anonymous(self, parts, params, body):
        self._at_least(parts, 1)
        items, values = _weighted(parts)
        return self.model.recommend_to_anonymous([self._id(i) for i in items], values, **self._options(params))

    def similarity(self, parts, params, body):
        self._at_least(parts, 1)
        return self.model.most_similar([self._id(p) for p in parts], **self._options(params))

    def similarity_to_item(self, parts, params, body):
        self._at_least(parts, 2)
        return self.model.similarity_to_item(self._id(parts[0]), [self._id(p) for p in parts[1:]])

    def estimate(self, parts, params, body):
        self._at_least(parts, 2)
        return self.model.estimate(self._id(parts[0]), [self._id(p) for p in parts[1:]])

    def estimate_for_anonymous(self, parts, params, body):
        self._at_least(parts, 2)
        items, values = _weighted(parts[1:])
        return self.model.estimate_for_anonymous(self._id(parts[0]), [self._id(i) for i in items], values)

    def because(self, parts, params, body):
        self._at_least(parts, 2, 2)
        return self.model.because(self._id(parts[0]), self._id(parts[1]), self._options(params)["n"])

    def most_popular(self, parts, params, body):
        self._at_least(parts, 0, 0)
        return self.model.most_popular(**self._options(params))

    def set_preference(self, parts, params, body):
        self._at_least(parts, 2, 2)
        self.model.set_preference(self._id(parts[0]), self._id(parts[1]), _number(body.strip() or "1"))

    def remove(self, parts, params, body):
        self._at_least(parts, 2, 2)
        self.model.remove(self._id(parts[0]), self._id(parts[1]))

    def ingest(self, parts, params, body):
        """Lines ``user,item[,value]``; an empty value deletes."""
        if not self.model.ready():
            raise NotReady("no model is loaded")
        rows = [(line,) for line in body.splitlines() if line.strip()]
        if not rows:
            raise BadRequest("no lines")
        parsed = preferences.with_ids(preferences.parse_lines(self.model.r.sparkSession.createDataFrame(rows, "value string")))
        self.model.ingest(parsed.select("user_id", "item_id", "value", "is_delete"))

    def ready(self, parts, params, body):
        if not self.model.ready():
            raise NotReady("no model is loaded")
        return True

    def routes(self):
        read = {
            "recommend": self.recommend, "recommendToMany": self.recommend_to_many, "recommendToAnonymous": self.recommend_to_anonymous,
            "similarity": self.similarity, "similarityToItem": self.similarity_to_item, "estimate": self.estimate, "estimateForAnonymous": self.estimate_for_anonymous,
            "because": self.because, "mostPopularItems": self.most_popular, "ready": self.ready,
        }
        out = {("GET", k): v for k, v in read.items()} | {("HEAD", "ready"): self.ready}
        if not self.model.read_only:
            out |= {("POST", "pref"): self.set_preference, ("DELETE", "pref"): self.remove, ("POST", "ingest"): self.ingest}
        return out


def _row(text: str, n: int) -> list[str]:
    """The fields of one delimited row; BadRequest where their number is wrong."""
    fields = next(csv.reader([text]), [])
    if len(fields) != n:
        raise BadRequest(f"{len(fields)} columns, not {n}")
    return fields


class ClusterRequests(_Routes):
    """Nearest centre of a row, and rows for the next generation."""

    def __init__(self, rows: RowVectors, centers: list[list[float]], added: Callable[[list[str]], None] = lambda lines: None):
        self.rows, self.added = rows, added
        self.index = clustering.CenterIndex([centers])

    def _nearest(self, parts) -> tuple[int, float]:
        vector = self.rows.vector(_row("/".join(parts), len(self.rows.columns)))
        if vector is None:
            raise BadRequest("a value is missing")
        center, sq = self.index.nearest(np.array([vector]), 0, exact=True)
        return int(center[0]), float(sq[0])

    def routes(self):
        return {
            ("GET", "assign"): lambda parts, params, body: self._nearest(parts)[0],
            ("GET", "distanceToNearest"): lambda parts, params, body: self._nearest(parts)[1],
            ("POST", "add"): lambda parts, params, body: self.added([line for line in body.splitlines() if line.strip()]),
        }


class ForestRequests(_Routes):
    """Predictions for a row without its target, and rows that update the leaves."""

    def __init__(self, spark, forest: Forest, columns: list[str], numeric: list[str]):
        self.spark, self.forest, self.columns, self.numeric = spark, forest, columns, numeric

    def _frame(self, lines: list[str]) -> DataFrame:
        rows = [_row(line, len(self.columns)) for line in lines]
        typed = [tuple(None if v == "" else _number(v) if c in self.numeric else v for c, v in zip(self.columns, r)) for r in rows]
        schema = ", ".join(f"`{c}` {'double' if c in self.numeric else 'string'}" for c in self.columns)
        return self.spark.createDataFrame(typed, schema)

    def classify(self, parts, params, body):
        """The target's field may be empty; an unseen category takes the default branch."""
        return self.forest.predict(self._frame(["/".join(parts)])).first()["prediction"]

    def train(self, parts, params, body):
        given = [line for line in body.splitlines() if line.strip()]
        if not given:
            raise BadRequest("no lines")
        self.forest.update(self._frame(given).where(F.col(self.forest.target).isNotNull()))

    def routes(self):
        return {("GET", "classify"): self.classify, ("POST", "train"): self.train}
