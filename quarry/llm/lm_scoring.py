"""Masked pseudo-likelihood with a bidirectional window network in numpy.

Every word is predicted from the words on both sides of it; a document's score
is the sum of the log-probabilities.  The vocabulary comes from counts of all
words of the corpus: the most frequent have their own id, as many as the square
root of the corpus's words; the rest share hashed ids, at least a quarter as
many.  The network sums the gated embeddings of the window, and its output is a
tree of softmaxes of 32 branches, so the work for a word grows with the
logarithm of the vocabulary.

Texts become ids once, in a table that training and scoring read.  Training goes
in rounds, each on its share of the documents, so that every document trains
once.  Shards (by a hash of id and text, as many as the corpus's size asks for)
improve copies of the network, each in the order of the hashes, and copies are
averaged with the words they saw as weights: how rows lie in partitions does
not matter, but for the rounding of sums.

Defined results: a null or empty text has no words, score 0 and no mean;
repeated rows count each; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches, discard, materialize
from .words import word_hashes


@dataclass(frozen=True)
class LmSettings:
    #: Words with their own id, and ids that the rest share, at least; more in a large corpus.
    frequent: int = 768
    hashed: int = 256
    branches: int = 32
    side: int = 3
    width: int = 16
    #: Each document trains in one of them.
    rounds: int = 2
    #: Words of one step, of a shard in a round (on average), and of a block to score.
    batch: int = 16384
    shard_words: int = 2_000_000
    block: int = 1 << 15
    rate: float = 0.02

    @property
    def ids(self) -> int:
        return self.frequent + self.hashed

    @property
    def depth(self) -> int:
        d = 1
        while self.branches**d < self.ids:
            d += 1
        return d


class Network:
    """Weights as one flat float32 vector with named views.

    ``out[k]`` belongs to the nodes of level k of the tree, its last row being
    the bias; a word's path are the digits of its id.
    """

    def __init__(self, s: LmSettings, flat: np.ndarray | None = None):
        self.s, b = s, s.branches
        nodes = [-(-s.ids // b ** (s.depth - k)) for k in range(s.depth)]
        shapes = [(s.ids + 1, s.width), (2 * s.side, s.width), (s.width,), *((n, s.width + 1, b) for n in nodes)]
        sizes = [int(np.prod(x)) for x in shapes]
        if flat is None:
            flat = np.random.default_rng(3).normal(0, 0.1, sum(sizes)).astype(np.float32)
            flat[sizes[0] : sizes[0] + sizes[1]] += 1
        self.flat = flat
        views = [x.reshape(shape) for x, shape in zip(np.split(flat, np.cumsum(sizes)[:-1]), shapes)]
        self.embed, self.gate, self.start = views[:3]
        self.out = views[3:]

    def contexts(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Ids beside each word (the pad id beyond an end), and the words."""
        side, pad = self.s.side, np.full(self.s.side, self.s.ids, np.int64)
        line = np.concatenate([x for t in texts for x in (pad, t)] + [pad]).astype(np.int64)
        at = np.flatnonzero(line != self.s.ids)
        return np.stack([line[at + d] for d in range(-side, side + 1) if d], 1), line[at]

    def _hidden(self, around: np.ndarray) -> np.ndarray:
        """Of the window, and a column of ones."""
        total, some = np.empty((2, len(around), self.s.width), self.flat.dtype)
        total[:] = self.start
        for d in range(around.shape[1]):
            total += np.take(self.embed * self.gate[d], around[:, d], 0, out=some, mode="clip")
        out = np.ones((len(around), self.s.width + 1), total.dtype)
        np.tanh(total, out=out[:, :-1])
        return out

    def _level(self, h: np.ndarray, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Logits of the branches at level k, the branch taken, and where nodes begin; words ascend."""
        b, below = self.s.branches, self.s.depth - 1 - k
        node, digit = words // b ** (below + 1), words // b**below % b
        first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        z = np.empty((len(words), b), h.dtype)
        for n, x, y in zip(node[first].tolist(), first.tolist(), [*first[1:].tolist(), len(words)]):
            np.matmul(h[x:y], self.out[k][n], out=z[x:y])
        np.clip(z, -80, 80, out=z)
        return z, digit, first, node[first]

    def log_probabilities(self, around: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Of each word given what is beside it."""
        order = np.argsort(words.astype(np.uint16) if self.s.ids < 1 << 16 else words, kind="stable")
        words, rows = words[order], np.arange(len(words))
        h, total, ones = self._hidden(around[order]), np.zeros(len(words)), np.ones(self.s.branches, self.flat.dtype)
        for k in range(self.s.depth):
            z, digit, _, _ = self._level(h, words, k)
            total += z[rows, digit]
            total -= np.log(np.exp(z, out=z) @ ones)
        out = np.empty(len(words))
        out[order] = total
        return out

    def gradient(self, around: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Of the mean negative log-probability."""
        g = Network(self.s, np.zeros_like(self.flat))
        order = np.argsort(words.astype(np.uint16) if self.s.ids < 1 << 16 else words, kind="stable")
        around, words, rows = around[order], words[order], np.arange(len(words))
        h = self._hidden(around)
        dh, ones = np.zeros((len(words), self.s.width), h.dtype), np.ones(self.s.branches, h.dtype)
        for k in range(self.s.depth):
            p, digit, first, nodes = self._level(h, words, k)
            np.exp(p, out=p)
            p /= (p @ ones)[:, None]
            p[rows, digit] -= 1
            for n, x, y in zip(nodes.tolist(), first.tolist(), [*first[1:].tolist(), len(words)]):
                np.matmul(h[x:y].T, p[x:y], out=g.out[k][n])
                dh[x:y] += p[x:y] @ self.out[k][n, :-1].T
        dh *= 1 - h[:, :-1] ** 2
        g.start[:] = dh.sum(0)
        dh = np.ascontiguousarray(dh.T, np.float64)
        embed, gate = np.ascontiguousarray(self.embed.T), self.gate.T
        dx = np.zeros(embed.shape)
        for d, own in enumerate(np.ascontiguousarray(around.T)):
            for j in range(self.s.width):  # of each id at this place, summed up
                at = np.bincount(own, dh[j], self.s.ids + 1)
                g.gate[d, j] = at @ embed[j]
                dx[j] += at * gate[j, d]
        g.embed[:] = dx.T
        return g.flat / len(words)


def word_ids(text: str | None, vocabulary: tuple[np.ndarray, np.ndarray], s: LmSettings) -> np.ndarray:
    """Ids of all words: frequency rank, or a hashed id beyond."""
    known, rank = vocabulary
    h = word_hashes(text)
    out = (s.frequent + h % np.uint64(s.hashed)).astype(np.int32)
    if len(known):
        at = np.searchsorted(known, h)
        at[at == len(known)] = 0
        own = known[at] == h
        out[own] = rank[at[own]]
    return out


def fitted(s: LmSettings, words: int, distinct: int) -> LmSettings:
    """Own ids for the square root of the corpus's words, and a quarter as many shared ones."""
    frequent = max(s.frequent, min(math.isqrt(words), distinct))
    return replace(s, frequent=frequent, hashed=max(s.hashed, frequent // 4))


def corpus_vocabulary(docs: DataFrame, settings: LmSettings = LmSettings(), text: str = "text") -> tuple[LmSettings, tuple[np.ndarray, np.ndarray], int]:
    """Settings that fit the corpus; sorted hashes of its most frequent words, and their ranks; the words in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, n = np.unique(np.concatenate([word_hashes(t) for t in b.column(0).to_pylist()] or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(text).cast("string").alias("text"))
    counted = materialize(texts.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    words, distinct = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    s = fitted(settings, words, distinct)
    top = [r.word for r in counted.orderBy(F.desc("n"), "word").limit(s.frequent).collect()]
    discard(counted)
    hashes = np.array(top, np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return s, (hashes[order], order.astype(np.int32)), words


_CODED = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("ids", pa.binary())])


def coded(docs: DataFrame, vocabulary: tuple[np.ndarray, np.ndarray], s: LmSettings, text: str = "text") -> DataFrame:
    """doc_id, a hash of the row, and the ids (little-endian, 32 bits) of every row, as a table."""
    shared = docs.sparkSession.sparkContext.broadcast((s, vocabulary))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, vocabulary = shared.value
        for b in batches:
            ids = [word_ids(t, vocabulary, s).astype("<i4").tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary())], schema=_CODED)

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("h"), "text")
    return materialize(rows.mapInArrow(code, "doc_id long, h long, ids binary"), "coded")


def _texts_of(b: pa.RecordBatch, column: int) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<i4") for x in b.column(column)]


def _improve(net: Network, texts: list[np.ndarray], state: list) -> None:
    """One Adam step on the words of the texts, in place."""
    s = net.s
    around, words = net.contexts(texts)
    for at in range(0, len(words), 2 * s.batch):  # a very long text takes several
        g = net.gradient(around[at : at + 2 * s.batch], words[at : at + 2 * s.batch])
        state[0] += 1
        state[1] += 0.1 * (g - state[1])
        state[2] += 0.01 * (g * g - state[2])
        k = state[0]
        net.flat -= (s.rate / (1 - 0.9**k)) * state[1] / (np.sqrt(state[2] / (1 - 0.99**k)) + 1e-6)


def improved(net: Network, texts: Iterator[np.ndarray]) -> int:
    """Train on texts in their order, in steps of the setting's words; the words seen."""
    state = [0, np.zeros_like(net.flat), np.zeros_like(net.flat)]
    held, size, seen = [], 0, 0
    for t in texts:
        if len(t):
            held.append(t)
            size += len(t)
        if size >= net.s.batch:
            _improve(net, held, state)
            held, size, seen = [], 0, seen + size
    if held:
        _improve(net, held, state)
    return seen + size


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of binary vectors."""
    total = None
    for b in batches:
        for x in b.column(0):
            own = np.frombuffer(x.as_buffer(), "<f8")
            total = own.copy() if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["weights"])


def train(table: DataFrame, words: int, s: LmSettings = LmSettings()) -> Network:
    """Rounds of local training of shards and averaging; the number of rounds is fixed."""
    net = Network(s)
    shards = max(1, round(words / s.rounds / s.shard_words))
    names = F.pmod(F.col("h"), F.lit(shards)).cast("int")
    for r in range(s.rounds):
        start = table.sparkSession.sparkContext.broadcast((s, net.flat))

        def local(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            s, flat = start.value
            sums, total = np.zeros(len(flat)), 0

            def shard_texts(first: pa.RecordBatch) -> Iterator[np.ndarray]:
                nonlocal left
                b, shard = first, first.column(0)[0].as_py()
                while b is not None:
                    cut = int(np.searchsorted(b.column(0).to_numpy(), shard, "right"))
                    yield from _texts_of(b.slice(0, cut), 1)
                    if cut < b.num_rows:
                        left = b.slice(cut)
                        return
                    b = next(filled, None)
                left = None

            filled = (b for b in batches if b.num_rows)
            left = next(filled, None)
            while left is not None:
                net = Network(s, flat.copy())
                seen = improved(net, shard_texts(left))
                sums += net.flat.astype(np.float64) * seen
                total += seen
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary()), pa.array([total], pa.int64())], names=["weights", "seen"])

        drawn = table.where(F.pmod(F.xxhash64("h", F.lit(21)), F.lit(s.rounds)) == r).select(names.alias("shard"), "ids", "h")
        drawn = drawn.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "h", "ids").select("shard", "ids")
        copies = materialize(drawn.mapInArrow(local, "weights binary, seen long"), "copies")
        total = copies.agg(F.sum("seen")).first()[0]
        if total:
            # Added up in two levels; one vector of the network's size comes to the driver.
            some = copies.select("weights").coalesce(math.isqrt(shards) + 1).mapInArrow(_added, "weights binary")
            mean = some.repartition(1).mapInArrow(_added, "weights binary").first()[0]
            net = Network(s, (np.frombuffer(mean, "<f8") / total).astype(np.float32))
        discard(copies)
    return net


_SCORES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("pll", pa.float64()), ("pll_per_token", pa.float64())])


def pseudo_likelihoods(net: Network, texts: list[np.ndarray]) -> np.ndarray:
    """Summed log-probabilities of each text."""
    out = np.zeros(len(texts))
    sizes = np.array([len(t) for t in texts])
    if not sizes.sum():
        return out
    around, words = net.contexts([t for t in texts if len(t)])
    of = np.repeat(np.arange(len(texts)), sizes)
    for at in range(0, len(words), net.s.block):
        own = slice(at, at + net.s.block)
        out += np.bincount(of[own], net.log_probabilities(around[own], words[own]), len(texts))
    return out


def score(table: DataFrame, net: Network) -> DataFrame:
    """doc_id, n_tokens, pll and pll_per_token of every row of a coded table."""
    shared = table.sparkSession.sparkContext.broadcast((net.s, net.flat))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(*shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 100):
                some = b.slice(at, 100)
                texts = _texts_of(some, 1)
                n, pll = [len(t) for t in texts], pseudo_likelihoods(own, texts).tolist()
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n, pa.int64()), pa.array(pll, pa.float64()), pa.array([p / k if k else None for p, k in zip(pll, n)], pa.float64())], schema=_SCORES)

    return table.select("doc_id", "ids").mapInArrow(scored, "doc_id long, n_tokens long, pll double, pll_per_token double")


def pseudo_likelihood_scores(docs: DataFrame, settings: LmSettings = LmSettings(), text: str = "text") -> DataFrame:
    """Count, train and score a corpus."""
    s, vocabulary, words = corpus_vocabulary(docs, settings, text)
    table = coded(docs, vocabulary, s, text)
    return score(table, train(table, words, s))
