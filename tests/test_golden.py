"""Known numbers: hashes, factors, cluster validity, entropy, schedules."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.config import ClusterSettings, InboundSettings, RecommenderSettings, overlay
from quarry.functions import ids, text
from quarry.operators import als, clustering, forest, lsh, preferences, recommend, topk
from quarry.plans.generation import Generations, schedule
from quarry.plans.serving import NotReady, Recommender, Rescorer, chain

R = np.array([[0, 2, 3, 1, 0], [0, 0, 4, 5, 0], [1, 0, 0, 0, 2], [3, 0, 1, 0, 5], [0, 2, 2, 2, 0]], float)
Y0 = [[0.1, 0.2], [0.2, 0.5], [0.3, 0.1], [0.2, 0.2], [0.5, 0.4]]


def ratings(spark, m):
    rows = [(int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(m) if v]
    return spark.createDataFrame(rows, "user_id long, item_id long, value double")


def factors(spark, rows):
    return spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "item_id long, features array<double>")


def test_string_ids(spark):
    df = spark.createDataFrame([("foo",), ("123",), ("-5",)], "n string").select(ids.to_long(F.col("n")).alias("i"))
    assert [r.i for r in df.collect()] == [-7363431537935844490, 123, -5]


@pytest.mark.parametrize("settings,m,want", [
    (RecommenderSettings(features=2), R, [-0.030258, 0.852781, 1.004839, 1.024087, -0.036206]),
    (RecommenderSettings(features=2, reconstruct_r=True), R, [0.0678369, 0.6574759, 2.1020291, 2.0976211, 0.1115919]),
])
def test_factors_reach_the_known_product(spark, settings, m, want):
    r, y = ratings(spark, m).cache(), factors(spark, Y0)
    k = len(Y0)
    x_rows = y_rows = None
    base = np.array(Y0)
    for _ in range(34 if settings.reconstruct_r else 28):  # in numpy, with the operator's own algebra
        def half(mat, other):
            gram, out = other.T @ other, []
            for row in mat:
                at = np.flatnonzero(row)
                w, b = als.normal_parts(row[at], other[at], settings)
                out.append(als._solved(gram, settings.lambda_ * settings.alpha, w, b, len(at)))
            return np.array(out, float)

        x_rows = half(m, base)
        base = half(m.T, x_rows)
    y_rows = base
    assert np.allclose((x_rows @ y_rows.T)[0], want, atol=2e-4)
    first = {q.user_id: q.features for q in als.half_step(r, y, settings).collect()}
    gram = np.array(Y0).T @ np.array(Y0)
    for u in range(k):
        at = np.flatnonzero(m[u])
        w, b = als.normal_parts(m[u][at], np.array(Y0)[at], settings)
        assert np.allclose(first[u], als._solved(gram, settings.lambda_ * settings.alpha, w, b, len(at)), atol=1e-6)


def test_singular_model_is_refused(spark):
    with pytest.raises(als.SingularModel) as e:
        als.check_rank(factors(spark, [[1.0, 1.0], [2.0, 2.0]]))
    assert e.value.rank == 1


def test_top_n_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(i, float(i // 2)) for i in range(10)] + [(99, None)], "item_id long, value double")
    assert [r.item_id for r in topk.top(df, 3).collect()] == [8, 9, 6]


def test_delimited_lines(spark):
    lines = spark.createDataFrame([('foo,"bar""bing"', 2), ("foo,bar,", 3), (",foo,bar", 3), ("", 0)], "v string, n int")
    got = [r.f for r in lines.select(text.decode_delimited(F.col("v"), 3).alias("f")).collect()]
    assert got[0][:2] == ["foo", 'bar"bing'] and got[1] == ["foo", "bar", ""] and got[2] == ["", "foo", "bar"] and got[3] == []


def test_preference_lines(spark):
    df = preferences.parse_lines(spark.createDataFrame([("u,i",), ("u,j,2.5",), ("u,k,",), ("u,l,NaN",)], "value string"))
    assert [(r.item, r.value, r.is_delete) for r in df.collect()] == [("i", 1.0, False), ("j", 2.5, False), ("k", None, True)]


def test_merge_rules(spark):
    old = spark.createDataFrame([(1, 1, 4.0), (1, 2, 4.0)], "user_id long, item_id long, value double")
    new = spark.createDataFrame([(1, 1, None, True), (1, 2, 1.0, False), (1, 3, None, True), (1, 3, 2.0, False)], "user_id long, item_id long, value double, is_delete boolean")
    assert sorted(map(tuple, preferences.merge(old, new, 0.5).collect())) == [(1, 2, 3.0), (1, 3, 2.0)]


def test_cluster_validity():
    x, w = np.array([[17, 30], [18, 27], [16, 22]], float), np.array([10, 20, 40], float)
    vd, vi = clustering.agreement(np.array([[70.0]]))
    assert math.isnan(vd) and math.isnan(vi)
    assert clustering.validity(x, w, x[:2], x[1:], 2, 0).test_cost > 0
    assert clustering.update_lloyd(np.array([[1, 1], [5, 4], [4, 3], [2, 1.0]]), np.ones(4), np.array([[1, 1], [5, 4.0]]), 5).tolist() == [[1.5, 1], [4.5, 3.5]]


def test_choice_of_k_prefers_stable_and_cheap():
    v = clustering.Validity
    stats = [v(1, 0, 1, 1, 0.0, 0.0), v(2, 0, 9, 9, 0.2, 0.2), v(5, 0, 4, 4, 0.9, 0.4), v(10, 0, 1, 1, 0.9, 0.9)]
    assert clustering.choose_k(stats, ClusterSettings()) == [stats[2]]
    assert clustering.choose_k(stats, ClusterSettings(evaluate="fixed", fixed_k=2)) == [stats[1]]


def test_entropy_and_gains():
    assert forest.entropy([2, 6]) == pytest.approx(0.5623351446188083)
    assert forest.entropy([1, 1]) == pytest.approx(math.log(2)) and forest.entropy([1]) == 0
    assert forest.information_gain([4, 0], [0, 4]) == pytest.approx(math.log(2))
    assert forest.variance_gain((2, 2.0, 2.0), (2, 4.0, 8.0)) is None


def test_forest_learns_and_votes(spark):
    from quarry.config import ForestSettings

    rows = [(i, float(i % 10), "ab"[i % 2], "yes" if i % 10 >= 5 else "no") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, x double, c string, y string")
    f = forest.build(df, "y", ["x"], ["c"], ForestSettings(trees=2, feature_fraction=1.0, max_depth=4))
    assert forest.evaluate(f.predict(df), "y", True).first().accuracy == 1.0
    assert {r.feature for r in f.importance(df).collect()} == {"x"}
    before = sum(n.counts[0] for n in f.trees[0].values() if n.feature is None)
    f.update(df)
    assert sum(n.counts[0] for n in f.trees[0].values() if n.feature is None) == before + 200


def test_hamming_distance_for_a_sample_ratio():
    assert lsh.max_distance(20, 0.1) == 6


def test_recommender_answers(spark):
    y = factors(spark, [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]])
    x = spark.createDataFrame([(7, [1.0, 0.5])], "user_id long, features array<double>")
    r = spark.createDataFrame([(7, 0, 1.0)], "user_id long, item_id long, value double")
    m = Recommender(x, y, r)
    assert [(q.item_id, q.value) for q in m.recommend(7).collect()] == [(2, 1.5), (1, 0.5)]
    twice = chain(Rescorer(lambda i, v: v * 2), Rescorer(is_filtered=lambda i: i == 1))
    assert [(q.item_id, q.value) for q in m.recommend(7, rescorer=twice).collect()] == [(2, 3.0)]
    assert m.estimate(7, [2, 55]).orderBy("item_id").collect()[1].value == 0.0
    assert m.because(7, 2).collect()[0].item_id == 0
    with pytest.raises(recommend.NoSuchUser):
        m.recommend(8)
    with pytest.raises(NotReady):
        Recommender().recommend(1)


def test_folding_in_stays_finite():
    x, y, g = [0.0, 0.0], [0.0, 0.1], np.eye(2)
    for i in range(1000):
        x, y = recommend.updated_vectors(x, y, 1.0 if i % 3 else -1.0, g, g)
    assert np.isfinite(x).all() and np.isfinite(y).all()


def test_schedule_and_roles():
    assert schedule([("c", "a"), ("c", "b"), ("b", "a"), ("d", None)]) == [["a", "d"], ["b"], ["c"]]
    with pytest.raises(ValueError):
        schedule([("a", "b"), ("b", "a")])
    s = InboundSettings(("a", "b", "c", "d", "e"), categorical=(1, 4), ids=(0,), ignored=(2,))
    assert s.roles["numeric"] == ["d"]
    with pytest.raises(ValueError):
        InboundSettings(("a",))
    assert overlay(ClusterSettings(), {"folds": 3}).folds == 3


def test_generations(spark, tmp_path):
    g = Generations(spark, f"file://{tmp_path}/m")
    assert g.open_next() == 0 and g.newest_done() is None and g.should_run(0)
    made = []
    for _ in range(2):
        g.table(0, "t", lambda: made.append(1) or spark.range(3))
    assert len(made) == 1
    g.finish(0, {"n": 3})
    assert g.newest_done() == 0 and g.open_next() == 1 and not g.should_run(1)
    assert '"n": 3' in g.store.read_text("00000/manifest.json")
    g.finish(1, {}, keep=1)
    assert g.every() == [1]
