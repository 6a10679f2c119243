"""Candidates by sign bits of random hyperplanes."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .blocks import BLOCK_ROWS, CELLS


def planes(hashes: int, size: int, seed: int = 1729) -> list[list[int]]:
    """±1 hyperplanes from MD5 bits of their place, the same on any engine."""
    from hashlib import md5

    return [[1 if md5(f"{seed}|{h}|{i}".encode()).digest()[0] & 1 else -1 for i in range(size)] for h in range(hashes)]


def signature(v: Column, mean: list[float], signs: list[list[int]]) -> Column:
    """One bit for each plane: whether the centred vector is on its upper side."""
    centred = F.zip_with(v, F.array(*map(F.lit, mean)), lambda x, m: x.cast("double") - m)
    bits = [F.when(V.total(F.zip_with(centred, F.array(*(F.lit(float(s)) for s in p)), lambda x, s: x * s)) > 0, F.lit(1 << h).cast("long")).otherwise(F.lit(0).cast("long")) for h, p in enumerate(signs)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def max_distance(hashes: int, ratio: float) -> int:
    """The largest Hamming distance whose share of all signatures is under ``ratio``."""
    shares = np.cumsum([comb(hashes, k) / 2**hashes for k in range(hashes + 1)])
    return max(0, int(np.searchsorted(shares, ratio)) - 1)


def near(asked: DataFrame, items: DataFrame, distance: int) -> DataFrame:
    """(asked, item_id): items within the distance of each asked signature.

    ``asked`` has (asked, signature), a query set; blocks of bounded size of it
    are broadcast, and items stream past each.
    """
    spark = items.sparkSession
    schema = pa.schema([("asked", pa.int64()), ("item_id", pa.int64())])
    out = spark.createDataFrame([], "asked long, item_id long")
    parts = -(-asked.count() // BLOCK_ROWS)
    for k in range(parts):
        block = asked.where(F.pmod(F.xxhash64("asked"), F.lit(parts)) == k).select("asked", "signature").toArrow()
        shared = spark.sparkContext.broadcast((block["asked"].to_numpy(), block["signature"].to_numpy()))

        def compare(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, own = shared.value
            step = max(1, CELLS // max(1, len(own)))
            for b in batches:
                item, signs = b.column(0).to_numpy(), b.column(1).to_numpy()
                for at in range(0, len(item), step):
                    i, j = np.nonzero(np.bitwise_count(signs[at : at + step, None] ^ own) <= distance)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[j]), pa.array(item[at : at + step][i])], schema=schema)

        out = out.union(items.select("item_id", "signature").mapInArrow(compare, "asked long, item_id long"))
    return out


class SignIndex:
    """Items with their signatures; ``mean`` is the items' centre."""

    def __init__(self, items: DataFrame, size: int, hashes: int = 20, ratio: float = 0.1, seed: int = 1729):
        if not 0 < hashes <= 62:
            raise ValueError("1 to 62 hashes")
        row = items.agg(V.mean_vector(F.col("features"), size).alias("m")).first()["m"]
        self.mean, self.signs, self.hashes = [float(m or 0) for m in row], planes(hashes, size, seed), hashes
        self.distance = max_distance(hashes, ratio)
        self.items = items.withColumn("signature", signature(F.col("features"), self.mean, self.signs))

    def signature_of(self, vector: list[float]) -> int:
        d = np.array(vector, float) - np.array(self.mean)
        return sum(1 << h for h, p in enumerate(self.signs) if float(np.array(p) @ d) > 0)

    def candidates(self, vector: list[float], added: DataFrame | None = None) -> DataFrame:
        """Items within the distance, and those added since."""
        near = self.items.where(F.bit_count(F.col("signature").bitwiseXOR(F.lit(self.signature_of(vector)).cast("long"))) <= self.distance)
        return near if added is None else near.unionByName(added, allowMissingColumns=True).dropDuplicates(["item_id"])
