"""Repeatable draws from keys: the same on any partitioning and engine."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column, seed: int | str) -> Column:
    """In [0, 1), from 52 bits of an MD5 of key and seed."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(4503599627370496.0)


def gaussian(key: Column, seed: int | str) -> Column:
    """Standard normal, by Box and Muller."""
    u = F.greatest(uniform(key, f"{seed}a"), F.lit(1e-300))
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * uniform(key, f"{seed}b"))


def gaussians(key: Column, size: int, seed: int | str) -> Column:
    return F.array(*(gaussian(key, f"{seed}.{i}") for i in range(size)))


def unit_vector(key: Column, size: int, seed: int | str) -> Column:
    from .vectors import normalize

    return normalize(gaussians(key, size, seed))


def fold(key: Column, folds: int, seed: int | str = 1729) -> Column:
    return F.least((uniform(key, seed) * folds).cast("int"), F.lit(folds - 1))
