"""Secret scanning: exact base patterns plus a linear-chain CRF.

One pass over the whole texts finds the base spans and the runs of tokens that
could hold a secret: those with a digit or a capital inside, after ``:`` or
``=``, or of 20 characters.  A tag dictionary allows only "outside" for every
other token, so the chain falls apart into these short runs without changing the
Viterbi path.  The CRF is trained with numpy on a bounded sample of runs whose
tags come from the base spans, cut at hashed places of the texts; it sees the
token's shape, the words and signs beside it and features of the file.  Spans of the CRF are added where no base
span is; base spans always stay.

Defined results: a null or empty text has no spans; repeated rows count each;
an empty table gives an empty result; a corpus without any base span trains a
model that adds nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches, materialize

KINDS = ("assign", "access", "hex", "crf")
_WORDS = ("password", "passwd", "secret", "token", "api")
_KEY = "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
_ASSIGN = re.compile(rf"(?:{_KEY})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(r"[A-Za-z+/_.-]*(?:[0-9]|[a-z][A-Z])[A-Za-z0-9+/_.-]*|(?<=[:=])[\"']?[A-Za-z+/_.-]{6,}|(?<=[:=] )[\"']?[A-Za-z+/_.-]{6,}|[A-Za-z+/_.-]{20,}")
_WORD_BEFORE = re.compile(r"([A-Za-z]+)[^A-Za-z\n]{1,6}\Z")
_WORD_AFTER = re.compile(r"[^A-Za-z\n]{1,6}([A-Za-z]+)")
_NEAR_KEY = re.compile(rf"(?:{_KEY}|[cC]redential|[pP]assphrase|[kK][eE][yY]|[aA]uth|[bB]earer)[^A-Za-z0-9\n]{{0,6}}$")
_GAP = re.compile(r"[^A-Za-z0-9\n]{0,3}$")

#: Sizes of the categorical features of a token.
FEATURES = {"shape": 64, "digits": 4, "hex": 2, "turns": 4, "key": 2, "before": 6, "after": 6, "word_before": 64, "word_after": 16, "file_tokens": 3, "file_signs": 3}
_BASE = np.cumsum([0, *FEATURES.values()])
OUT, BEGIN, INSIDE = 0, 1, 2
#: The number of the feature that a key word is near.
_KEYED = int(_BASE[list(FEATURES).index("key")]) + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, by start and then kind."""
    low = text.lower()
    found = []
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def span_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _beside(c: str) -> int:
    return 0 if not c else 1 if c in "=:" else 2 if c in "\"'`" else 3 if c.isspace() else 4 if c == "@" else 5


def _word(found: re.Match | None, of: int) -> int:
    """A hashed feature of a neighbouring word; 0 for none."""
    return 1 + crc32(found[1].lower().encode()) % (of - 1) if found else 0


def _features(text: str, a: int, b: int, file: tuple[int, int]) -> list[int]:
    t = text[a:b]
    n, digits = b - a, sum(map(str.isdigit, t))
    lower, upper = any(map(str.islower, t)), any(map(str.isupper, t))
    size = 0 if n < 12 else 1 if n < 20 else 2 if n < 32 else 3
    kinds = [0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in t]
    turns = sum(x != y for x, y in zip(kinds, kinds[1:])) / n
    shape = lower + 2 * upper + 4 * (digits > 0) + 8 * (3 in kinds) + 16 * size
    at = a
    while at > 0 and text[at - 1] == " ":
        at -= 1
    values = (
        shape,
        min(3, int(4 * digits / n)),
        int(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", t) is not None),
        min(3, int(6 * turns)),
        int(_NEAR_KEY.search(text, max(0, a - 30), a) is not None),
        _beside(text[at - 1 : at]),
        _beside(text[b : b + 1]),
        _word(_WORD_BEFORE.search(text, max(0, a - 30), a), FEATURES["word_before"]),
        _word(_WORD_AFTER.match(text, b, b + 30), FEATURES["word_after"]),
        *file,
    )
    return [int(o + v) for o, v in zip(_BASE, values)]


def runs(text: str) -> list[list[tuple[int, int, list[int]]]]:
    """Runs of neighbouring tokens that may be secrets: (start, end, features)."""
    found = [(m.start() + (text[m.start()] in "\"'"), m.end()) for m in _TOKEN.finditer(text)]
    found = [(a, b) for a, b in found if b - a >= 6]
    if not found:
        return []
    signs = sum(map(text.count, "={};")) / len(text)
    file = (0 if len(found) < 3 else 1 if len(found) < 12 else 2, 0 if signs < 0.002 else 1 if signs < 0.01 else 2)
    out: list = []
    for a, b in found:
        token = (a, b, _features(text, a, b, file))
        if out and a - out[-1][-1][1] <= 3 and _GAP.fullmatch(text, out[-1][-1][1], a):
            out[-1].append(token)
        else:
            out.append([token])
    return out


def silver_tags(run: list[tuple[int, int, list[int]]], spans: list[tuple[int, int, int]]) -> list[int]:
    tags, last = [], None
    for a, b, _ in run:
        here = next((s for s in spans if s[0] < b and a < s[2]), None)
        tags.append(OUT if here is None else INSIDE if here == last else BEGIN)
        last = here
    return tags


@dataclass(frozen=True)
class Crf:
    """Weights of features by tag, of tag pairs, and of the first tag."""

    emit: np.ndarray
    move: np.ndarray
    begin: np.ndarray
    trained: bool = True

    def decode(self, features: list[list[int]]) -> list[int]:
        """The best tag sequence of a run (Viterbi)."""
        if not self.trained:
            return [OUT] * len(features)
        score, back = self.begin + self.emit[features[0]].sum(0), []
        for f in features[1:]:
            all_moves = score[:, None] + self.move
            back.append(all_moves.argmax(0))
            score = all_moves.max(0) + self.emit[f].sum(0)
        tags = [int(score.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]


@dataclass(frozen=True)
class ScanSettings:
    #: About so many runs with, and without, a base span are read for training.
    train_runs: int = 3000
    #: Longer runs are cut in parts, for training only.
    train_length: int = 24
    steps: int = 200
    rate: float = 0.1
    l2: float = 1e-3
    names: tuple[str, ...] = field(default=KINDS)


def train_crf(samples: list[tuple[list[list[int]], list[int]]], s: ScanSettings = ScanSettings()) -> Crf:
    """Maximum likelihood by Adam on forward-backward gradients, in numpy."""
    width = int(_BASE[-1])
    emit, move, begin = np.zeros((width, 3)), np.zeros((3, 3)), np.zeros(3)
    if not any(any(tags) for _, tags in samples):
        return Crf(emit, move, begin, trained=False)
    samples = [(f[: s.train_length], t[: s.train_length]) for f, t in samples]
    n, longest = len(samples), max(len(t) for _, t in samples)
    x = np.zeros((n, longest, len(FEATURES)), np.int64)
    y = np.zeros((n, longest), np.int64)
    mask = np.zeros((n, longest))
    for i, (f, t) in enumerate(samples):
        x[i, : len(t)], y[i, : len(t)], mask[i, : len(t)] = f, t, 1
    rows, gold = np.arange(n), np.eye(3)[y] * mask[:, :, None]
    theta = [emit, move, begin]
    m, v = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta]
    pair_gold = np.einsum("nta,ntb->ab", gold[:, :-1] * mask[:, 1:, None], gold[:, 1:])
    lse = lambda z, axis: z.max(axis) + np.log(np.exp(z - z.max(axis, keepdims=True)).sum(axis))
    ends = mask.sum(1).astype(int) - 1
    for step in range(1, s.steps + 1):
        emit, move, begin = theta
        e = emit[x].sum(2)
        alpha, beta = np.zeros((n, longest, 3)), np.zeros((n, longest, 3))
        alpha[:, 0] = begin + e[:, 0]
        for t in range(1, longest):
            alpha[:, t] = np.where(mask[:, t, None] > 0, lse(alpha[:, t - 1, :, None] + move, 1) + e[:, t], alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            beta[:, t] = np.where(mask[:, t + 1, None] > 0, lse(move + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
        z = lse(alpha[rows, ends], 1)
        node = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        g_emit = np.zeros_like(emit)
        np.add.at(g_emit, x.reshape(-1), np.repeat((node - gold).reshape(-1, 3), len(FEATURES), 0))
        g_move = -pair_gold
        for t in range(1, longest):
            joint = alpha[:, t - 1, :, None] + move + (e[:, t] + beta[:, t])[:, None, :] - z[:, None, None]
            g_move = g_move + (np.exp(joint) * mask[:, t, None, None]).sum(0)
        grads = [g_emit / n + s.l2 * emit, g_move / n + s.l2 * move, (node[:, 0] - gold[:, 0]).sum(0) / n + s.l2 * begin]
        for i, g in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            theta[i] = theta[i] - s.rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Crf(*theta)


_SCAN = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("positive", pa.bool_())])
_SCAN_SQL = "doc_id long, base array<long>, tokens array<long>, lengths array<long>, positive boolean"
_WIDTH = 3 + len(FEATURES)


def scan_row(text: str | None) -> tuple[list[int], list[int], list[int], bool]:
    """Flat lists: base spans by 3, tokens by (start, end, tag, features)."""
    if not text:
        return [], [], [], False
    spans, tokens, lengths, positive = base_spans(text), [], [], False
    for run in runs(text):
        tags = silver_tags(run, spans)
        positive = positive or any(tags)
        lengths.append(len(run))
        for (a, b, f), t in zip(run, tags):
            tokens += (a, b, t, *f)
    return [x for s in spans for x in s], tokens, lengths, positive


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [scan_row(t) for t in b.column(1).to_pylist()]
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(_SCAN)[1:]))], schema=_SCAN)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Base spans and feature runs of each document."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_scan_batches, _SCAN_SQL)


def _cut(tokens: list[int], lengths: list[int]) -> list[list[list[int]]]:
    cells = [tokens[i : i + _WIDTH] for i in range(0, len(tokens), _WIDTH)]
    out, at = [], 0
    for n in lengths:
        out.append(cells[at : at + n])
        at += n
    return out


def _parts(scanned: DataFrame, s: ScanSettings) -> DataFrame:
    """All runs in parts of the training length.

    A token beside a key word that no base pattern covers is not known to be
    clean, so parts with one do not train.
    """
    out = pa.schema([("cells", pa.list_(pa.int64())), ("positive", pa.bool_())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells, positive = [], []
            for tokens, lengths in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for run in _cut(tokens, lengths):
                    for at in range(0, len(run), s.train_length):
                        part = run[at : at + s.train_length]
                        if any(c[2] == OUT and _KEYED in c[3:] for c in part):
                            continue
                        cells.append([x for c in part for x in c])
                        positive.append(any(c[2] for c in part))
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.list_(pa.int64())), pa.array(positive, pa.bool_())], schema=out)

    return scanned.where(F.size("lengths") > 0).select("tokens", "lengths").mapInArrow(cut, "cells array<long>, positive boolean")


def fit(scanned: DataFrame, s: ScanSettings = ScanSettings()) -> Crf:
    """Train on about ``train_runs`` parts of runs of either kind, chosen by hash.

    Equal parts (repeated rows) count once, so the sample is bounded.
    """
    parts = _parts(scanned, s)
    sizes = dict(parts.groupBy("positive").count().collect())
    samples = []
    for positive in (True, False):
        share = min(1.0, s.train_runs / max(1, sizes.get(positive, 0)))
        chosen = parts.where((F.col("positive") == positive) & (F.pmod(F.xxhash64("cells"), F.lit(1 << 30)) < int(share * (1 << 30)))).select("cells").distinct()
        for row in sorted(r.cells for r in chosen.collect()):
            cells = [row[i : i + _WIDTH] for i in range(0, len(row), _WIDTH)]
            samples.append(([c[3:] for c in cells], [c[2] for c in cells]))
    return train_crf(samples, s)


def added_spans(crf: Crf, base: list[tuple[int, int, int]], cut: list[list[list[int]]]) -> list[tuple[int, int, int]]:
    """Spans of the CRF that overlap no base span."""
    found: list[list[int]] = []
    for run in cut:
        inside = False
        for cell, tag in zip(run, crf.decode([c[3:] for c in run])):
            if tag == INSIDE and inside:
                found[-1][1] = cell[1]
            elif tag != OUT:
                found.append([cell[0], cell[1]])
            inside = tag != OUT
    return [(a, 3, b) for a, b in found if not any(x < b and a < y for x, _, y in base)]


def _spans_of(crf: Crf, base: list[int], tokens: list[int], lengths: list[int]) -> tuple[list, list]:
    spans = [tuple(base[i : i + 3]) for i in range(0, len(base), 3)]
    return spans, sorted(spans + added_spans(crf, spans, _cut(tokens, lengths)))


def find_secrets(docs: DataFrame, settings: ScanSettings = ScanSettings(), text: str = "text") -> DataFrame:
    """doc_id, span counts by kind, and base and all spans as text."""
    scanned = materialize(scan(docs, text), "secrets")
    crf = fit(scanned, settings)
    out = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base", pa.string()), ("base_sha256", pa.string()), ("spans", pa.string())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, base, tokens, lengths in zip(*(b.column(i).to_pylist() for i in range(4))):
                own, every = _spans_of(crf, base, tokens, lengths)
                shown = span_text(own)
                counts = [sum(k == i for _, k, _ in every) for i in range(len(KINDS))]
                rows.append((doc_id, *counts, shown, hashlib.sha256(shown.encode()).hexdigest(), span_text(every)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(out), out)], schema=out)

    return scanned.mapInArrow(decode, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, base_sha256 string, spans string")


def redact(docs: DataFrame, settings: ScanSettings = ScanSettings(), text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, with every secret in ``text`` replaced."""
    scanned = materialize(scan(docs, text), "secrets")
    crf = fit(scanned, settings)
    schema, at = docs.schema, docs.columns.index(text)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for t in b.column(at).to_pylist():
                if t:
                    base, tokens, lengths, _ = scan_row(t)
                    kept, at_char = [], 0
                    for x, _, y in _spans_of(crf, base, tokens, lengths)[1]:
                        if x >= at_char:
                            kept += (t[at_char:x], mark)
                        at_char = max(at_char, y)
                    t = "".join([*kept, t[at_char:]])
                texts.append(t)
            columns = list(b.columns)
            columns[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(replace, schema)
