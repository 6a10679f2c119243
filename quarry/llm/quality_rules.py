"""Host-level quality rules with an empirical beta prior.

Each document is measured once (one vectorized pass over its whole text); rule
failures are summed by host with map-side combining, each host's failure rate
is shrunk towards a beta prior fitted to all hosts by moments, and the verdict
on a host is joined back to its documents.  Only numbers are shuffled, never
texts, and the join is planned from the measured size of the host table: a hot
host costs no more than its rows.

Defined results: a null or empty text has no words and fails the base rules; a
null host is a host of its own; repeated rows count each; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches, materialize

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_UPPER = re.compile(rb"[A-Z]")
_SPACES = tuple(" \t\n\v\f\r")
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), *((m, pa.int64()) for m in METRICS)])


@dataclass(frozen=True)
class RuleSettings:
    """Limits of the rules; rates are in per cent so that all tests are exact."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbols_per_100_words: int = 10
    max_dup_line_percent: int = 60
    max_upper_percent: int = 50
    #: A host is rejected when a shrunk failure rate is above this.
    max_host_rate: float = 0.5
    #: Limits of the prior's weight, counted in documents.
    min_prior_docs: float = 1.0
    max_prior_docs: float = 1000.0


def measure(text: str | None) -> tuple[int, ...]:
    """The METRICS of one text."""
    if not text:
        return (0,) * len(METRICS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            often = {w for w, c in Counter(windows).items() if c > 1}
            covered = 0
            for i, w in enumerate(windows):
                if w in often:
                    repeated += 3 - max(0, covered - i)
                    covered = i + 3
    lines = [x for x in raw.split(b"\n") if x.split()]
    return (
        n,
        len(text) - sum(map(text.count, _SPACES)),
        len(_SYMBOLS.findall(text)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        len(_UPPER.findall(raw)),
    )


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        columns = list(zip(*map(measure, b.column(2).to_pylist()))) or [()] * len(METRICS)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in columns)], schema=_SCHEMA)


def document_metrics(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    bounded_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(_measure_batches, "doc_id long, host string, " + ", ".join(f"{m} long" for m in METRICS))


def rules(s: RuleSettings) -> dict[str, Column]:
    """Rule name to the condition that a document fails it."""
    c = F.col
    return {
        "short": c("n_words") < s.min_words,
        "repeats": 100 * c("n_repeat_words") > s.max_repeat_percent * c("n_words"),
        "symbols": 100 * c("n_symbols") > s.max_symbols_per_100_words * c("n_words"),
        "dup_lines": 100 * c("n_dup_lines") > s.max_dup_line_percent * c("n_lines"),
        "upper": 100 * c("n_upper") > s.max_upper_percent * c("word_chars"),
    }


def host_rates(failures: DataFrame, names: list[str], s: RuleSettings) -> DataFrame:
    """One row for each host: documents, failures and shrunk rates by rule."""
    hosts = failures.groupBy("host").agg(F.count("*").alias("host_docs"), *(F.sum(F.col(f"fails_{r}").cast("long")).alias(f"f_{r}") for r in names))
    hosts = materialize(hosts, "hosts")
    rate = {r: F.col(f"f_{r}") / F.col("host_docs") for r in names}
    prior = hosts.agg(*(F.avg(rate[r]).alias(f"m_{r}") for r in names), *(F.var_pop(rate[r]).alias(f"v_{r}") for r in names)).first()
    shrunk = []
    for r in names:
        m, v = prior[f"m_{r}"] or 0.0, prior[f"v_{r}"] or 0.0
        weight = s.max_prior_docs if v < 1e-12 else min(max(m * (1 - m) / v - 1, s.min_prior_docs), s.max_prior_docs)
        shrunk.append(((F.col(f"f_{r}") + F.lit(m * weight)) / (F.col("host_docs") + F.lit(weight))).alias(f"rate_{r}"))
    return hosts.select("host", "host_docs", *shrunk)


def host_quality(docs: DataFrame, settings: RuleSettings = RuleSettings(), text: str = "text", host: str = "source") -> DataFrame:
    """Every document with its metrics, its failed rules and the verdicts.

    A document is kept when it fails no rule itself and its host's shrunk
    failure rates are all at most ``max_host_rate``.
    """
    tests = rules(settings)
    names = list(tests)
    measured = document_metrics(docs, text, host).withColumn("host", F.concat(F.when(F.col("host").isNull(), "n").otherwise("h"), F.coalesce("host", F.lit(""))))
    measured = materialize(measured, "metrics")
    failures = measured.select("*", *(t.alias(f"fails_{r}") for r, t in tests.items()))
    hosts = host_rates(failures, names, settings)
    rejected = F.greatest(*(F.col(f"rate_{r}") for r in names)) > settings.max_host_rate
    joined = failures.join(hosts.select("host", "host_docs", F.round(F.greatest(*(F.col(f"rate_{r}") for r in names)), 6).alias("host_rate"), rejected.alias("host_rejected")), "host", "left")
    base = F.col("fails_short") | F.col("fails_repeats")
    own = base
    for r in names:
        own = own | F.col(f"fails_{r}")
    return joined.withColumns({"base_failed": base, "kept": ~(own | F.coalesce("host_rejected", F.lit(False)))})
