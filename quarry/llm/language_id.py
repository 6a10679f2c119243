"""Language identification with interpolated Kneser-Ney character models.

For each language, however many there are, a four-letter model is estimated
from a bounded sample of its labelled rows; probabilities (already interpolated) and backoff weights live in
arrays sorted by n-gram hash, one column for each language, and are broadcast.
A text goes to the language with the lowest cross-entropy per letter; a
logistic calibration on other sampled rows turns the margin into a score, and
texts below the calibrated score or with an unusual entropy are marked as not
accepted.

Letters are what Unicode says (categories L); a language of few rows trains on
all of them.  Of many languages each gets its share of ``train_rows``.

Defined results: null texts and texts without a letter are ``und`` with score
0; ties go to the first language in order; with no labelled row every text is
``und``; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches, materialize
from .words import mix

ORDER = 4
_LETTERS = re.compile(r"[^\W\d_]+")
_ROLL = np.random.default_rng(7).integers(0, 2**64, ORDER, dtype=np.uint64) | np.uint64(1)


@dataclass(frozen=True)
class LanguageSettings:
    #: Expected labelled rows of each language to train on, and to calibrate on.
    train_docs: int = 1500
    calibrate_docs: int = 400
    #: Rows of all languages that are read, about; at least ``few`` of each.
    train_rows: int = 60_000
    #: Languages of no more rows train on all of them.
    few: int = 50
    #: Letters that an unseen letter shares its probability with.
    alphabet: int = 1000
    accept_score: float = 0.5


def letters(text: str | None) -> str:
    """Lower-case words of letters, a space before and after each."""
    found = _LETTERS.findall((text or "").lower())
    line = f" {' '.join(found)} " if found else ""
    if not line.replace(" ", "a").isalpha():  # numbers such as one half are in \w too
        found = "".join(c if c.isalpha() else " " for c in line).split()
        line = f" {' '.join(found)} " if found else ""
    return line


def _hashes(points: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that ends at each position from n - 1 on."""
    h = np.full(max(0, len(points) - n + 1), np.uint64(n), np.uint64)
    for i in range(n):
        h += points[i : len(points) - n + 1 + i] * _ROLL[i]
    return mix(h)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, (keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool))


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    #: By order, from 1: sorted hashes and log-probabilities (keys x languages).
    grams: list[tuple[np.ndarray, np.ndarray]]
    #: By order of the context, from 0: sorted hashes and log backoff weights.
    backoff: list[tuple[np.ndarray, np.ndarray]]
    #: Log-probability of an unseen letter by language.
    unseen: np.ndarray
    #: Weights of (1, margin, log letters), and the highest usual entropy.
    calibration: tuple[float, float, float] = (0.0, 10.0, 0.0)
    usual: float = 1e9

    def entropies(self, text: str | None) -> tuple[np.ndarray, int]:
        """Cross-entropy for each letter by language, and the letters."""
        line = letters(text)
        total, n = np.zeros(len(self.languages)), max(0, len(line) - 1)
        points = _points(line)
        block = 1 << 20
        for at in range(0, n, block):
            total += self._log_probability(points[max(0, at - ORDER + 2) : at + 1 + block], 1 if at == 0 else ORDER - 1)
        return -total / max(n, 1), n

    def _log_probability(self, points: np.ndarray, skip: int) -> np.ndarray:
        """Sum over the positions from ``skip`` on, given what is before them."""
        total = np.zeros(len(self.languages))
        hashes = [_hashes(points, k) for k in range(1, ORDER + 1)]
        for p in range(skip, min(ORDER - 1, len(points))):  # the start has shorter contexts
            total += self._backed_off(hashes, np.array([p]), p + 1)
        if len(points) >= ORDER:
            total += self._backed_off(hashes, np.arange(max(skip, ORDER - 1), len(points)), ORDER)
        return total

    def _backed_off(self, hashes: list[np.ndarray], at: np.ndarray, order: int) -> np.ndarray:
        total = np.zeros(len(self.languages))
        for k in range(order, 0, -1):
            if not len(at):
                return total
            keys, logs = self.grams[k - 1]
            index, seen = _find(keys, hashes[k - 1][at - k + 1])
            total += np.bincount(index[seen], minlength=len(keys)) @ logs if seen.sum() > len(keys) // 4 else logs[index[seen]].sum(0)
            at = at[~seen]
            if k > 1 and len(at):
                contexts, weights = self.backoff[k - 1]
                index, seen = _find(contexts, hashes[k - 2][at - k + 1])
                total += weights[index[seen]].sum(0)
        return total + len(at) * self.unseen


def estimate(counts: dict[str, Counter], s: LanguageSettings) -> LanguageModel:
    """Interpolated Kneser-Ney from four-letter counts by language."""
    languages = sorted(counts)
    width = len(languages)
    c = {g: np.zeros(width) for l in languages for g in counts[l]}
    for j, l in enumerate(languages):
        for g, n in counts[l].items():
            c[g][j] = n
    levels = [c]
    for _ in range(ORDER - 1):  # lower orders count the letters seen before
        lower: dict[str, np.ndarray] = {}
        for g, n in levels[0].items():
            if g[1:] not in lower:
                lower[g[1:]] = np.zeros(width)
            lower[g[1:]] += n > 0
        levels.insert(0, lower)
    grams, backoff, below, unseen = [], [], None, None
    for k, level in enumerate(levels, 1):
        names = sorted(level)
        table = np.array([level[g] for g in names]).reshape(len(names), width)
        ones, twos = (table == 1).sum(0), (table == 2).sum(0)
        discount = np.clip(ones / np.maximum(ones + 2 * twos, 1), 0.1, 0.95)
        contexts = sorted({g[:-1] for g in names})
        place = {h: i for i, h in enumerate(contexts)}
        of = np.array([place[g[:-1]] for g in names], int)
        sums, kinds = np.zeros((len(contexts), width)), np.zeros((len(contexts), width))
        np.add.at(sums, of, table)
        np.add.at(kinds, of, table > 0)
        share = np.where(sums > 0, discount * kinds / np.maximum(sums, 1), 1.0)
        lower_p = np.full((len(names), width), 1 / s.alphabet) if below is None else np.array([below[g[1:]] for g in names])
        p = np.where(sums[of] > 0, np.maximum(table - discount, 0) / np.maximum(sums[of], 1), 0) + share[of] * lower_p
        if below is None:
            unseen = np.log(share[0] / s.alphabet)
        below = dict(zip(names, p))
        for strings, values, into in ((names, p, grams), (contexts, share, backoff)):
            keys = np.array([_hashes(_points(g), len(g))[0] if g else np.uint64(0) for g in strings], np.uint64)
            order = np.argsort(keys)
            into.append((keys[order], np.log(values[order]).astype(np.float32)))
    return LanguageModel(languages, grams, backoff, unseen)


def _sample(docs: DataFrame, learn: Column, s: LanguageSettings) -> DataFrame | None:
    """A bounded, repeatable sample of labelled rows, about even by language."""
    labelled = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = labelled.groupBy("lang").count().collect()  # one row for each language
    if not sizes:
        return None
    wanted = max(s.few, min(s.train_docs + s.calibrate_docs, s.train_rows // len(sizes)))
    learnt = max(1, wanted * s.train_docs // (s.train_docs + s.calibrate_docs))
    rates = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, wanted / r["count"]), r["count"] <= s.few) for r in sizes], "lang string, share double, all_train boolean")
    labelled = labelled.select("doc_id", "text", "lang").join(F.broadcast(rates), "lang")
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1_000_000)) / 1e6
    train = F.col("all_train") | (F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(wanted)) < learnt)
    return materialize(labelled.where(draw < F.col("share")).select("text", "lang", train.alias("train")), "language-sample")


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, Counter] = {}
    for b in batches:
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            line, own = letters(text), found.setdefault(lang, Counter())
            own.update(map("".join, zip(*(line[i:] for i in range(ORDER)))))
    for lang, own in found.items():
        yield pa.RecordBatch.from_pydict({"lang": [lang] * len(own), "gram": list(own), "n": list(own.values())}, schema=pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())]))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (p - y) + 1e-2 * w)
    return w


def train(docs: DataFrame, learn: Column, s: LanguageSettings = LanguageSettings()) -> LanguageModel | None:
    """Fit on rows of (doc_id, text, lang) for which ``learn`` holds."""
    bounded_batches(docs.sparkSession)
    sample = _sample(docs, learn, s)
    if sample is None:
        return None
    counted = sample.where("train").select("text", "lang").mapInArrow(_count_batches, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n"))
    counts: dict[str, Counter] = {}
    for lang, gram, n in counted.collect():  # bounded by the sample
        counts.setdefault(lang, Counter())[gram] = n
    if not counts:
        return None
    model = estimate(counts, s)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h, n = model.entropies(text)
                if n:
                    best, margin = _choose(h)
                    rows.append((model.languages[best] == lang, margin, float(h[best]), n))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 4, (pa.bool_(), pa.float64(), pa.float64(), pa.int64()))], names=["right", "margin", "entropy", "n"])

    seen = sample.where("not train").select("text", "lang").mapInArrow(margins, "right boolean, margin double, entropy double, n long").collect()
    if not seen:
        return model
    table = np.array([(r.right, r.margin, r.entropy, r.n) for r in seen], float)
    w = _logistic(np.column_stack([np.ones(len(table)), table[:, 1], np.log(table[:, 3])]), table[:, 0])
    own = table[:, 2]
    usual = float(own.mean() + 6 * own.std() + 0.1)
    return LanguageModel(model.languages, model.grams, model.backoff, model.unseen, tuple(map(float, w)), usual)


def _choose(h: np.ndarray) -> tuple[int, float]:
    best = int(h.argmin())
    return best, float(np.partition(h, 1)[1] - h[best]) if len(h) > 1 else 1.0


def predict(docs: DataFrame, model: LanguageModel | None, s: LanguageSettings = LanguageSettings()) -> DataFrame:
    """doc_id, lang_pred, score, entropy and accepted of (doc_id, text)."""
    out = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("entropy", pa.float64()), ("accepted", pa.bool_())])
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                h, n = m.entropies(text) if m else (None, 0)
                if not n:
                    rows.append(("und", 0.0, None, False))
                    continue
                best, margin = _choose(h)
                w = m.calibration
                score = 1 / (1 + np.exp(-np.clip(w[0] + w[1] * margin + w[2] * np.log(n), -30, 30)))
                rows.append((m.languages[best], float(score), float(h[best]), bool(score >= s.accept_score and h[best] <= m.usual)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * 4, list(out)[1:]))], schema=out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(label, "doc_id long, lang_pred string, score double, entropy double, accepted boolean")
