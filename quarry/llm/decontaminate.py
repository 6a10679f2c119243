"""Benchmark decontamination: BM25 inverted index with block-max WAND.

The test items are the indexed side, in shards of bounded size that are
broadcast; every passage of every training document is a query.  Scores are
BM25 divided by the item's score with itself, so that one threshold fits all
items.  Bounds of blocks of items (sparse, by term) are added up for many
passages of a document at once, and only blocks that can reach the threshold are searched by WAND,
whose pivots skip items that cannot.  All items at or above the threshold are
retrieved; an item is a leak where the shingles of its question, or of the whole
item, are in the passage and its answer too: as shingles, or as words in order
next to the question.  Case and signs at the edges of words do not count.
Nothing is shuffled.

Items are indexed by length class, with passages of twice the class's length
and half that as the step, so an item lies whole in some passage wherever it
stands.  The answer of an item is its last sentence, its question the rest.

Defined results: null or empty texts and items give no hit; repeated rows and
items count each; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches
from .words import shingles, word_hashes

_LAST_SENTENCE = re.compile(r"[.?!:]\s+(?=\S)|\n+(?=\S)")


@dataclass(frozen=True)
class LeakSettings:
    #: Share of an item's own BM25 score that a passage must reach.
    threshold: float = 0.5
    shingle: int = 5
    #: Share of the question's or whole item's shingles, and of the answer.
    overlap: float = 0.8
    k1: float = 1.2
    b: float = 0.75
    block: int = 4
    least_words: int = 64
    #: Characters of test items in one broadcast index, whose arrays have about 20 bytes for each.
    shard_chars: int = 8_000_000
    #: Cells (halves of passages x blocks) of which bounds are added up at once.
    cells: int = 1 << 20


def question_and_answer(text: str) -> tuple[str, str]:
    cuts = list(_LAST_SENTENCE.finditer(text.rstrip()))
    return (text[: cuts[-1].end()], text[cuts[-1].end() :]) if cuts else (text, "")


def _words(text: str | None) -> np.ndarray:
    """Without case, of any letters, and without signs at the edges."""
    return word_hashes((text or "").lower(), strip=True)


def in_order(answer: np.ndarray, words: np.ndarray) -> float:
    """Share of the answer's words that stand in the words in order."""
    best = np.zeros(len(words) + 1, np.int64)
    for a in answer:
        best[1:] = np.maximum(best[1:], (best[:-1] + 1) * (words == a))
        best = np.maximum.accumulate(best)
    return int(best[-1]) / len(answer)


class BlockMaxIndex:
    """Postings of items by term and block, with the largest weight of each.

    All are sparse sorted arrays: entries (a term in a block) by term, then
    block; postings by entry, then item.
    """

    def __init__(self, items: list[tuple[int, str]], s: LeakSettings, step: int):
        self.settings, self.step = s, step
        self.items = [i for i, _ in items]
        words = [_words(t) for _, t in items]
        #: Question, answer and whole item.
        self.parts = [tuple(self._part(_words(p)) for p in (*question_and_answer(t), t)) for _, t in items]
        self.answers = [_words(question_and_answer(t)[1]) for _, t in items]
        own = [np.unique(w, return_counts=True) for w in words]
        self.vocabulary, df = np.unique(np.concatenate([u for u, _ in own]), return_counts=True)
        idf = np.log(1 + (len(items) - df + 0.5) / (df + 0.5))
        mean = sum(map(len, words)) / len(words)
        self.n_blocks = -(-len(items) // s.block)
        weights = []
        for (u, tf), w in zip(own, words):
            weight = idf[np.searchsorted(self.vocabulary, u)] * tf * (s.k1 + 1) / (tf + s.k1 * (1 - s.b + s.b * len(w) / mean))
            weights.append(weight / weight.sum())
        term = np.searchsorted(self.vocabulary, np.concatenate([u for u, _ in own]))
        item = np.repeat(np.arange(len(items)), [len(u) for u, _ in own])
        order = np.lexsort((item, term))
        term, self.item, self.weight = term[order], item[order].astype(np.int32), np.concatenate(weights)[order]
        key = term * self.n_blocks + self.item // s.block
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        #: Of each entry: term and block as one number, largest weight, and first posting (and the end of the last).
        self.key, self.start = key[start], np.append(start, len(key))
        self.bound = np.maximum.reduceat(self.weight, start) * (1 + 1e-6)
        #: First entry of each term (and the end of the last).
        self.of_term = np.searchsorted(self.key, np.arange(len(self.vocabulary) + 1) * self.n_blocks)

    def postings(self, entry: int) -> list[tuple[int, float]]:
        own = slice(self.start[entry], self.start[entry + 1])
        return list(zip(self.item[own].tolist(), self.weight[own].tolist()))

    def entries(self, terms: np.ndarray, block: int) -> np.ndarray:
        """Entries of the terms that are in a block."""
        wanted = terms * self.n_blocks + block
        at = np.searchsorted(self.key, wanted)
        at[at == len(self.key)] = 0
        return at[self.key[at] == wanted]

    def reached(self, half: np.ndarray, term: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Passages (two halves each) and the blocks whose bounds reach the threshold there."""
        n = int(half[-1]) + 1
        step = max(1, self.settings.cells // self.n_blocks)
        counts = self.of_term[term + 1] - self.of_term[term]
        for p in range(0, n, step):
            x, y = np.searchsorted(half, [p, p + step + 1])  # one half more
            size = counts[x:y]
            of = np.repeat(np.arange(x, y), size)
            entry = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + self.of_term[term[of]]
            cell = (half[of] - p) * self.n_blocks + self.key[entry] % self.n_blocks
            sums = np.bincount(cell, self.bound[entry], (step + 1) * self.n_blocks if n > step else (n - p + 1) * self.n_blocks).reshape(-1, self.n_blocks)
            may = sums[:-1] + sums[1:] >= self.settings.threshold * 0.999
            for k in np.flatnonzero(may.any(1)).tolist():
                yield p + k, np.flatnonzero(may[k])

    def _part(self, words: np.ndarray) -> tuple[int, np.ndarray]:
        """A part's shingles in order, and their words: a short part is one."""
        k = max(1, min(self.settings.shingle, len(words)))
        return k, shingles(words, k)

    def _beside(self, item: int, words: np.ndarray, at: int) -> float:
        """Share of the answer in order after the last of the question there."""
        answer, (k, question) = self.answers[item], self.parts[item][0]
        passage = shingles(words[at : at + 2 * self.step], k)
        there = np.flatnonzero(np.isin(question, passage)) if len(words) - at >= k else []
        if not len(answer) or not len(there):
            return 0.0
        left = len(question) - 1 - int(there[-1]) + 2 * len(answer) + 8
        ends = np.flatnonzero(passage == question[there[-1]]) + at + k
        return max(in_order(answer, words[e : e + left]) for e in ends.tolist())

    def search(self, terms: np.ndarray, blocks: np.ndarray) -> list[tuple[int, float]]:
        """WAND: items of the blocks whose score reaches the threshold."""
        least, found = self.settings.threshold - 1e-9, []
        for block in blocks.tolist():
            cursors = [[self.postings(e), 0, float(self.bound[e])] for e in self.entries(terms, block).tolist()]
            while cursors:
                cursors.sort(key=lambda c: c[0][c[1]][0])
                bound, pivot = 0.0, None
                for k, c in enumerate(cursors):
                    bound += c[2]
                    if bound >= least:
                        pivot = k
                        break
                if pivot is None:
                    break
                item = cursors[pivot][0][cursors[pivot][1]][0]
                if cursors[0][0][cursors[0][1]][0] == item:
                    score = 0.0
                    for c in cursors:
                        if c[0][c[1]][0] == item:
                            score += c[0][c[1]][1]
                            c[1] += 1
                    if score >= least:
                        found.append((item, score))
                else:
                    for c in cursors[:pivot]:
                        while c[1] < len(c[0]) and c[0][c[1]][0] < item:
                            c[1] += 1
                cursors = [c for c in cursors if c[1] < len(c[0])]
        return found

    def hits(self, words: np.ndarray) -> dict[int, tuple[int, float, float, float]]:
        """Leaked items to (first word of the passage, score, overlaps)."""
        s, out = self.settings, {}
        at = np.searchsorted(self.vocabulary, words)
        at[at == len(self.vocabulary)] = 0
        where = np.flatnonzero(self.vocabulary[at] == words)
        if not len(where):
            return out
        n = len(self.vocabulary)
        pairs = np.unique((where // self.step) * n + at[where])
        half, term = pairs // n, pairs % n
        for p, blocks in self.reached(half, term):
            terms = np.unique(term[np.searchsorted(half, p) : np.searchsorted(half, p + 2)])
            inside: dict[int, np.ndarray] = {}
            for item, score in self.search(terms, blocks):
                for k, _ in self.parts[item]:
                    if k not in inside:
                        inside[k] = np.unique(shingles(words[p * self.step : (p + 2) * self.step], k))
                question, answer, whole = (1.0 if not len(x) else float(np.isin(np.unique(x), inside[k]).mean()) for k, x in self.parts[item])
                if max(question, whole) >= s.overlap > answer:
                    answer = max(answer, self._beside(item, words, p * self.step))
                if min(max(question, whole), answer) >= s.overlap and (item not in out or out[item][1] < score):
                    out[item] = (p * self.step, score, question, answer)
        return {self.items[i]: v for i, v in out.items()} if len(set(self.items)) == len(self.items) else self._by_id(out)

    def _by_id(self, out: dict) -> dict:
        best: dict = {}
        for i, v in out.items():
            if self.items[i] not in best or best[self.items[i]][1] < v[1]:
                best[self.items[i]] = v
        return best


def build(items: list[tuple[int, str]], s: LeakSettings = LeakSettings()) -> list[BlockMaxIndex]:
    """One index for each length class of items."""
    classes = defaultdict(list)
    for i, t in sorted((i, t) for i, t in items if t):
        n, step = len(_words(t)), s.least_words
        while step < n:
            step *= 2
        if n:
            classes[step].append((i, t))
    return [BlockMaxIndex(own, s, step) for step, own in sorted(classes.items())]


def indexes(benchmark: DataFrame, s: LeakSettings, text: str = "text") -> Iterator[list[BlockMaxIndex]]:
    """Indexes of one shard of the test items after the other, each bounded."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).where("item_id is not null and text is not null")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = -(-chars // s.shard_chars)
    for k in range(shards):
        own = rows if shards == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == k)
        yield build([tuple(r) for r in own.collect()], s)


_HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("passage_word", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
_HITS_SQL = "doc_id long, item_id long, passage_word long, score double, question_overlap double, answer_overlap double"


def leaks(docs: DataFrame, benchmark: DataFrame, settings: LeakSettings = LeakSettings(), text: str = "text") -> DataFrame:
    """One row for each leaked item of each document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = spark.createDataFrame([], _HITS_SQL)
    for index in indexes(benchmark, settings):
        shared = spark.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for doc_id, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    words = _words(t)
                    for own in shared.value:
                        out += [(doc_id, item, *v) for item, v in own.hits(words).items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [()] * len(_HITS), _HITS)], schema=_HITS)

        found = found.union(rows.mapInArrow(search, _HITS_SQL))
    return found


def clean(docs: DataFrame, benchmark: DataFrame, settings: LeakSettings = LeakSettings(), text: str = "text") -> DataFrame:
    """The rows of ``docs`` without any leaked item, unchanged."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text)
    for index in indexes(benchmark, settings):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                words = (_words(t) for t in b.column(at).to_pylist())
                yield b.filter(pa.array([not any(own.hits(w) for own in shared.value) for w in words], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
