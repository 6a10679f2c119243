"""Row normalization and one-hot encoding to vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import summary


def transform(x: Column, kind: str, stats: dict[str, float]) -> Column:
    """none, z, linear or log; a column without spread stays as it is."""
    x = x.cast("double")
    if kind == "none":
        return x
    if kind == "z":
        return (x - stats["mean"]) / stats["stddev"] if stats["stddev"] else x
    if kind == "linear":
        width = stats["max"] - stats["min"]
        return (x - stats["min"]) / width if width else x
    if kind == "log":
        return F.ln(x)
    raise ValueError(f"unknown transform {kind}")


def one_hot(x: Column, levels: list[str], scale: float = 1.0) -> Column:
    return F.transform(F.array(*(F.lit(v) for v in levels)), lambda v: F.when(v == x.cast("string"), scale).otherwise(0.0))


def choose(columns: list[str], default: str, **by_kind: list[str]) -> dict[str, str]:
    """Column to transform; a column listed twice is an error."""
    out = dict.fromkeys(columns, default)
    seen: set[str] = set()
    for kind, names in by_kind.items():
        for n in names:
            if n in seen:
                raise ValueError(f"column {n} has two transforms")
            seen.add(n)
            out[n] = kind
    return out


def standardize(df: DataFrame, numeric: list[str], categorical: list[str], kinds: dict[str, str] | None = None, scales: dict[str, float] | None = None, ids: list[str] | None = None) -> DataFrame:
    """(ids…, vec): numbers and one-hot levels in column order.

    Rows with a missing number or category are dropped.
    """
    kinds, scales = kinds or {}, scales or {}
    stats, known = summary.counted(df, numeric) if numeric else {}, summary.levels(df, categorical)
    parts = []
    for c in df.columns:
        if c in numeric:
            parts.append(F.array(transform(F.col(c), kinds.get(c, "none"), stats[c]) * scales.get(c, 1.0)))
        elif c in categorical:
            parts.append(one_hot(F.col(c), known[c], scales.get(c, 1.0)))
    present = summary.complete(df, [*numeric, *categorical])
    for c in numeric:
        present = present.where(~F.isnan(F.col(c).cast("double")))
    return present.select(*(ids or []), F.concat(*parts).alias("vec"))
