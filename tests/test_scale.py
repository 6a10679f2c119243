"""Steps that must stay bounded as tables grow: tasks, passes and what is sent."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.config import RecommenderSettings
from quarry.functions.random import unit_vector
from quarry.operators import als, blocks, recommend
from quarry.plans import queries as base
from quarry.plans import storage
from quarry.streaming import flows

DIR = "/root/testdata/sf0.001"


def tasks(df) -> int:
    return df.select(F.spark_partition_id()).distinct().count()


def test_a_batch_of_many_files(spark, tmp_path):
    """Files of one batch are merged at once: a delete in one does not cancel what another adds."""
    at, schema = f"file://{tmp_path}", "user_id long, item_id long, value double, is_delete boolean"
    merge = lambda: sorted(map(tuple, flows.merge_stream(spark, f"{at}/in", schema, f"{at}/state", f"{at}/check", files=None).collect()))
    for rows, want in (([(1, 1, 2.0, False), (2, 2, 1.0, False)], [(1, 1, 2.0), (2, 2, 1.0)]), ([(1, 1, 3.0, False), (1, 1, None, True)], [(1, 1, 3.0), (2, 2, 1.0)])):
        spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(f"{at}/in")
        assert merge() == want and merge() == want


def test_stream_is_written_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(storage, "TASK_ROWS", 500)
    before = set(_streams(spark))
    base.stream_merge(spark, DIR).count()
    (own,) = set(_streams(spark)) - before
    assert spark.read.parquet(f"{own}/inbound").select(F.input_file_name()).distinct().count() > 3


@pytest.mark.parametrize("name", ["pref_merge", "pref_merge_decay"])
def test_merges_are_dealt_by_rows(spark, monkeypatch, name):
    whole = sorted(map(tuple, base.QUERIES[name](spark, DIR).collect()))
    monkeypatch.setattr(storage, "TASK_ROWS", 500)
    df = base.QUERIES[name](spark, DIR)
    assert tasks(df) > 6 and sorted(map(tuple, df.collect())) == whole


def test_preferences_are_dealt_by_rows(spark, monkeypatch):
    """What als_convergence joins with itself, and the other queries start from."""
    change = base.als_convergence(spark, DIR).first()
    monkeypatch.setattr(storage, "TASK_ROWS", 500)
    assert tasks(base.prefs(spark, DIR)) > 6 and base.als_convergence(spark, DIR).first() == change


def test_trailing_hour_against_all_pairs(spark):
    """Ties, hours apart to the microsecond, NaN, and events without a value, a time or a type."""
    rng = np.random.default_rng(5)
    hour = 3_600_000_000
    times = [*(int(t) for t in rng.integers(0, 4 * hour, 60)), 0, 0, hour, hour, hour + 1, 2 * hour, 2 * hour + 1, -1, None, None]
    rows = [(i, t, "ab"[i % 2] if i % 7 else None, None if i % 11 == 3 else float("nan") if i % 13 == 4 else float(i * 37 % 17)) for i, t in enumerate(times * 2)]
    events = spark.createDataFrame(rows, "event_id long, t long, event_type string, value double").withColumn("ts", F.timestamp_micros("t"))
    order = lambda v: (v != v, v)
    want = {}
    for i, t, k, _ in rows:
        frame = [v for _, u, other, v in rows if other == k and ((t is None and u is None) or (t is not None and u is not None and t - hour <= u <= t))]
        held = sorted((v for v in frame if v is not None), key=order)
        want[i] = (len(frame), repr(held[0]), repr(held[-1])) if held else (len(frame), "None", "None")
    assert {r.event_id: (r.n, repr(r.low), repr(r.high)) for r in flows.trailing_stats(events).collect()} == want


def test_trailing_hour_of_a_full_slot(spark):
    """No frame is gone through row by row: each ends or begins where its slot does."""
    plan = flows.trailing_stats(base.load(spark, DIR, "events"))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedpreceding" in plan and "-3600000000" not in plan


def _brute(users, items, n, known, cosine):
    """All scores in double precision; equal to ten digits means equal, and then by id."""
    out = []
    for u, x in users:
        scored = []
        for i, y in items:
            if x is None or y is None or i in known.get(u, ()) or (cosine and i == u):
                continue
            a, b = np.array(x, float), np.array(y, float)
            with np.errstate(all="ignore"):
                s = a / np.linalg.norm(a) @ (b / np.linalg.norm(b)) if cosine else a @ b
            if np.isfinite(s):
                scored.append((-round(float(s), 10) + 0.0, i))
        out += [(u, i, round(-s, 7) + 0.0) for s, i in sorted(scored)[:n]]
    return sorted(out)


@pytest.mark.parametrize("cosine", [False, True])
def test_best_pairs_against_all_pairs(spark, monkeypatch, cosine):
    """Equal and nearly equal vectors, zeros, huge numbers, no vector, many known items; one block and several."""
    rng = np.random.default_rng(11)
    some = rng.normal(size=(40, 6)).astype(np.float32)
    vectors = [list(map(float, some[i % 40])) for i in range(1200)]
    vectors[7], vectors[8], vectors[9] = [0.0] * 6, [float("nan")] * 6, None
    vectors[10] = [float(np.float32(v * (1 + 1e-7))) for v in vectors[50]]
    vectors[11] = [float("inf")] + [1.0] * 5
    items = list(enumerate(vectors))
    users = [(u, vectors[u % 60]) for u in range(200)] + [(1000, [1e20] * 6), (1001, [1e-25] * 6)]
    known = {u: sorted(map(int, rng.choice(1200, 3 if u % 5 else 1150, replace=False))) for u in range(0, 200, 2)}
    schema = "features array<float>"
    y = spark.createDataFrame(items, f"item_id long, {schema}").coalesce(1)
    if cosine:
        got = lambda: sorted((r.user_id, r.item_id, round(r.value, 7) + 0.0) for r in recommend.similar_items(y, 4).collect())
        want = _brute(items, items, 4, {}, True)
    else:
        x = spark.createDataFrame([(u, v, known.get(u)) for u, v in users], f"user_id long, {schema}, known array<bigint>").coalesce(1)
        got = lambda: sorted((r.user_id, r.item_id, round(r.value, 7) + 0.0) for r in blocks.best_pairs(x, y, 4).collect() if r.user_id != 1000)
        want = _brute([u for u in users if u[0] != 1000], items, 4, known, False)
    assert got() == want
    monkeypatch.setattr(blocks, "BLOCK_NUMBERS", 6 * 300)
    assert got() == want


def test_scoring_is_dealt_to_tasks(spark):
    """One file of vectors is little text and much work."""
    y = base._items(spark, DIR).coalesce(1)
    plan = recommend.similar_items(y, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan


def test_estimates_send_no_vectors_with_pairs(spark, monkeypatch):
    """Several blocks of items, unknown users and items, pairs that repeat; never a join of shuffled pairs and items."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    rng = np.random.default_rng(2)
    f = lambda n: [(i, [float(v) for v in rng.integers(-4, 5, 3)]) for i in range(n)]
    users, items = f(20), f(30)
    pairs = [(int(u), int(i)) for u, i in rng.integers(0, 35, (200, 2))] + [(None, 1), (1, None)]
    x, y = spark.createDataFrame(users, "user_id long, features array<float>"), spark.createDataFrame(items, "item_id long, features array<float>")
    p, xs, ys = spark.createDataFrame(pairs, "user_id long, item_id long"), dict(users), dict(items)
    want = sorted((str(u), str(i), float(np.dot(xs[u], ys[i])) if u in xs and i in ys else 0.0) for u, i in pairs)
    got = lambda: sorted((str(r.user_id), str(r.item_id), r.value) for r in recommend.estimates(p, x, y).collect())
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = recommend.estimates(p, x, y)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 1 and got() == want
        monkeypatch.setattr(recommend, "BROADCAST_NUMBERS", 30)
        assert got() == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


@pytest.mark.parametrize("k", [3, 20])
def test_systems_are_solved_where_they_are_added_up(spark, k):
    """Rows cut by batches, hot ones, both ways of adding up; no k×k matrix leaves a task but a hot row's."""
    rng = np.random.default_rng(4)
    s = RecommenderSettings(features=k)
    f = rng.normal(size=(30, k))
    cells = [(u, i, float(1 + (u * i) % 4)) for u in range(12) for i in range(30) if u == 5 or (u + i) % 3 == 0]
    r, y = spark.createDataFrame(cells, "user_id long, item_id long, value double"), spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(f)], "item_id long, features array<double>")
    want = {}
    for u in range(12):
        own = [(i, v) for w, i, v in cells if w == u]
        w, b = als.normal_parts(np.array([v for _, v in own]), f[[i for i, _ in own]], s)
        want[u] = als._solved(f.T @ f * (not s.loss_ignores_unspecified), s.lambda_ * s.alpha, w, b, len(own))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(key)
    try:
        spark.conf.set(key, "4")
        for hot_rows in (200_000, 11):
            got = {q.user_id: q.features for q in als.half_step(r, y, s, hot_rows).collect()}
            assert got.keys() == want.keys() and all(np.allclose(got[u], want[u], atol=1e-4) for u in want)
    finally:
        spark.conf.set(key, held)
    assert "Array(DoubleType" not in als.half_step(r, y, s)._jdf.queryExecution().analyzed().toString() and als.half_step(r, y, s)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_first_factors_make_each_number_once(spark):
    ids = spark.range(20).select(F.col("id").alias("item_id"))
    plan = als.initial_factors(ids, 10)._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("md5(") <= 20
    got = {r.item_id: r.features for r in als.initial_factors(ids, 10).collect()}
    want = {r.id: r.v for r in spark.range(20).select("id", unit_vector(F.col("id"), 10, 1729).cast("array<float>").alias("v")).collect()}
    assert got == want


def _streams(spark) -> list[str]:
    from pathlib import Path

    return [f"file://{p}" for p in Path(storage.shared_folder(spark).removeprefix("file://")).glob("stream-*")]
