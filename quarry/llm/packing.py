"""Packing by concatenate and cut, with two-pass prefix sums.

The first pass encodes every document once, in the order of its partition, and
writes ids with the running count inside the partition.  The partitions' totals
then give each partition's place in the whole stream, and the second pass cuts
each document where the stream crosses a multiple of the sequence length.  No
row is shuffled; every sequence but the last is full, so padding is at most one
sequence in all.  Boundary records (one for each piece) say where every
document starts and goes on.

Defined results: a null or empty text is its separator alone; repeated rows are
packed each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches, materialize
from .tokenizing import encode_texts, vocabulary


@dataclass(frozen=True)
class PackSettings:
    length: int = 1024
    separator: int = 0


#: ids have ``width`` bytes each, two where that is enough.
_ENCODED = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("local_start", pa.int64()), ("width", pa.int32()), ("ids", pa.binary())])
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
_PIECES_SQL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def encode_stream(docs: DataFrame, tokenizer: str, settings: PackSettings, text: str) -> DataFrame:
    """First pass: ids of each document and the count before it in its partition."""
    end = np.array([settings.separator], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for b in batches:
            for at in range(0, b.num_rows, 200):
                some = b.slice(at, 200)
                ids = [x + end for x in encode_texts(tokenizer, some.column(1).to_pylist())]
                counts = np.array([len(x) // 4 for x in ids], np.int64)
                starts = start + np.cumsum(counts) - counts
                start += int(counts.sum())
                flat = np.frombuffer(b"".join(ids), "<u4")
                width = 2 if flat.max() < 1 << 16 else 4
                numbers = (np.full(len(ids), part, np.int32), starts, np.full(len(ids), width, np.int32))
                yield pa.RecordBatch.from_arrays([some.column(0), *map(pa.array, numbers), _binary(flat.astype(f"<u{width}"), counts)], schema=_ENCODED)

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(encode, "doc_id long, part int, local_start long, width int, ids binary")


def _binary(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The ids as one cell for each count of them."""
    offsets = np.concatenate(([0], np.cumsum(counts * ids.itemsize))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])


def _flat(cells: pa.Array, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after another, and how many each cell has."""
    cells = cells.cast(pa.binary())
    offsets = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1]
    data = np.frombuffer(cells.buffers()[2] or b"", np.uint8)
    if (width == width[0]).all():
        ids = data[offsets[0] : offsets[-1]].view(f"<u{width[0]}").astype("<u4")
    else:
        ids = np.concatenate([data[x:y].view(f"<u{w}").astype("<u4") for x, y, w in zip(offsets, offsets[1:], width)])
    return ids, np.diff(offsets) // width


def pack(docs: DataFrame, tokenizer: str | None = None, settings: PackSettings = PackSettings(), text: str = "text") -> DataFrame:
    """One row for each piece of a document, with its ids (little-endian u32)."""
    encoded = materialize(encode_stream(docs, tokenizer or vocabulary(), settings, text), "packing")
    sizes = encoded.groupBy("part").agg(F.max(F.col("local_start") + F.octet_length("ids").cast("long") / F.col("width")).cast("long"))
    totals = dict(sizes.collect())  # one number for each partition of the scan
    parts = sorted(totals)
    before = np.zeros(max(parts, default=0) + 1, np.int64)
    if parts:
        before[parts] = np.concatenate(([0], np.cumsum([totals[p] for p in parts])[:-1]))
    window = settings.length

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            doc_id, part, local, width = (b.column(i) for i in range(4))
            ids, n = _flat(b.column(4), width.to_numpy())
            n, place = n.astype(np.int64), before[part.to_numpy()] + local.to_numpy()
            pieces = (place + n - 1) // window - place // window + 1
            row = np.repeat(np.arange(len(n)), pieces)
            sequence = place[row] // window + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first, end = np.maximum(place[row], sequence * window), np.minimum((place + n)[row], (sequence + 1) * window)
            cuts = np.cumsum(end - first).tolist()
            crc = [zlib.crc32(ids[x:y]) for x, y in zip([0, *cuts], cuts)]
            columns = (first - place[row], end - first, np.array(crc, np.int64), n[row], sequence, first - sequence * window)
            yield pa.RecordBatch.from_arrays([doc_id.take(pa.array(row)), *map(pa.array, columns), _binary(ids, end - first)], schema=_PIECES)

    return encoded.mapInArrow(cut, _PIECES_SQL)


def boundaries(pieces: DataFrame) -> DataFrame:
    """Where documents start and end inside sequences, for attention masks."""
    return pieces.select("sequence_id", "offset", "length", "doc_id", (F.col("start") > 0).alias("continued"), (F.col("start") + F.col("length") < F.col("doc_tokens")).alias("goes_on"))
