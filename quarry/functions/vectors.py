"""Vector algebra on array columns; everything stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0).cast("double"), lambda s, x: s + x)


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") * y)


def divide(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.try_divide(x.cast("double"), y))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y)


def scale(a: Column, by: Column | float) -> Column:
    return F.transform(a, lambda x: x.cast("double") * by)


def dot(a: Column, b: Column) -> Column:
    return total(multiply(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, scale(a, 1 / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """NULL where a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def l1_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)))


def max_distance(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)))


def append(a: Column, x: Column) -> Column:
    return F.concat(a, F.array(x))


def part(a: Column, start: int, length: int) -> Column:
    return F.slice(a, start + 1, length)


def of_columns(*names: str) -> Column:
    return F.array(*(F.col(n).cast("double") for n in names))


def mean_vector(a: Column, size: int) -> Column:
    """Element-wise mean of a vector column, an aggregate with partial sums."""
    return F.array(*(F.avg(a[i].cast("double")) for i in range(size)))


def weighted_mean(x: Column, w: Column) -> Column:
    """An aggregate; over a window frame rows that leave it are taken off again."""
    return F.try_divide(F.sum(x * w), F.sum(F.when(x.isNotNull(), w)))


def to_text(a: Column) -> Column:
    """``x,y,…``, or ``size:i=x,…`` where fewer than half of the elements are not zero."""
    dense = F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    kept = F.filter(F.transform(a, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda e: e["x"] != 0)
    sparse = F.concat(F.size(a).cast("string"), F.lit(":"), F.array_join(F.transform(kept, lambda e: F.concat_ws("=", e["i"].cast("string"), e["x"].cast("string"))), ","))
    return F.when(F.size(kept) * 2 < F.size(a), sparse).otherwise(dense)


def from_text(t: Column) -> Column:
    """The array of doubles of either form."""
    dense = F.transform(F.filter(F.split(t, ","), lambda x: x != ""), lambda x: x.try_cast("double"))
    body = F.split(t, ":")[1]
    cells = F.map_from_entries(F.transform(F.filter(F.split(body, ","), lambda e: e != ""), lambda e: F.struct(F.split(e, "=")[0].cast("int").alias("k"), F.split(e, "=")[1].cast("double").alias("v"))))
    size = F.split(t, ":")[0].try_cast("int")
    sparse = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.coalesce(F.element_at(cells, i), F.lit(0.0)))
    return F.when(t.contains(":"), sparse).otherwise(dense)


def either(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
