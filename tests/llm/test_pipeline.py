"""The pipeline's stages on their own input, against slow versions."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import quality_classifier, secret_scan

from . import brute
from .test_llm import slow_ids

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables with copies, leaks, odd texts, repeated ids and extra columns."""
    at = f"file://{tmp_path_factory.mktemp('pipeline')}"
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    some = [r for r in docs.where("length(text) > 400").orderBy("doc_id").limit(12).collect()]
    more = [(10_000 + i, r.text + " end", r.lang, r.source, r.n_chars) for i, r in enumerate(some)]
    more += [(some[0].doc_id, some[0].text, "en", "s", 1), (some[1].doc_id, some[2].text, "en", "s", 1), (20_001, None, None, None, None), (20_002, "", "en", None, 0), (20_003, "word " * 20_000, "en", "s", 100_000), (None, some[3].text, "en", "s", 5)]
    whole = docs.union(spark.createDataFrame(more, SCHEMA)).withColumn("score", F.lit("x")).withColumn("key", F.lit(None).cast("int"))
    whole.write.parquet(f"{at}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DIR}/{name}.parquet").write.parquet(f"{at}/{name}.parquet")
    return at


def held(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_every_stage_does_its_work(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    quality, dedup, clean, secrets, pack = (stage for _, stage in corpus_pipeline.STAGES)

    ranking = quality_classifier.train(docs, spark.read.parquet(f"{folder}/labels.parquet"), corpus_pipeline.fold(5) != 0)
    good = quality(spark, docs, folder)
    want = Counter({k: n for k, n in held(docs).items() if ranking.scores(np.array([quality_classifier.features(k[1])]))[0] >= 0.3})
    assert held(good) == want and 0 < sum(want.values()) < docs.count() and good.columns == docs.columns

    # All rows, so that copies and odd texts meet the next stage whatever the classifier says.
    one = dedup(spark, docs, folder)
    rows = [(i, k) for i, k in enumerate(sorted(held(docs), key=lambda k: (k[0] is None, k[0] or 0, k[1] or "")))]
    texts = {i: k[1] for i, k in rows}
    group = brute.near_duplicate_components([(i, t) for i, t in texts.items()], 5)
    left = held(one)
    by = Counter()
    for i, k in rows:
        if group[i][0] and k[0] is not None:
            by[group[i][1]] += left[k]
        else:
            assert left[k] == (held(docs)[k] if k[0] is None else 1)
    assert set(by.values()) == {1} and one.columns == docs.columns
    assert sum(left.values()) < docs.count() - 12

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    numbered = list(enumerate(rows_of(docs)))
    leaked = {i for i, _ in brute.leaks([(i, t) for i, (_, t) in numbered], items)}
    assert leaked and held(clean(spark, docs, folder)) == Counter(k for i, k in numbered if i not in leaked)

    redacted = secrets(spark, docs, folder)
    for r in redacted.collect():
        assert not secret_scan.base_spans((r.text or "").replace("[SECRET]", " ")) and (r.text is None or r.n_chars == len(r.text))
    assert redacted.count() == docs.count() and redacted.columns == docs.columns

    pieces = pack(spark, docs, folder).orderBy("sequence_id", "offset").collect()
    place = 0
    for r in pieces:
        assert r.sequence_id * 1024 + r.offset == place
        place += r.length
    assert place == sum(n * (len(slow_ids(t)) + 1) for (_, t), n in held(docs).items())


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_the_run_is_the_stages_in_order(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        at = f"{folder}/after-{name}"
        stage(spark, docs, folder).write.parquet(at)
        docs = spark.read.parquet(at)
    place = lambda df: Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    total = lambda c: {d: sum(k[2] * n for k, n in c.items() if k[0] == d) for d in {k[0] for k in c}}
    assert total(place(corpus_pipeline.run(spark, folder))) == total(place(docs)) != {}


def test_empty_documents(spark, folder, tmp_path):
    at = f"file://{tmp_path}"
    spark.createDataFrame([], SCHEMA).write.parquet(f"{at}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{at}/{name}.parquet")
    assert corpus_pipeline.run(spark, at).count() == 0
