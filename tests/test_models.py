"""Model files, requests, live updates, generations' input and smaller operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.config import ClusterSettings, ForestSettings, GenerationSettings, InboundSettings, RecommenderSettings
from quarry.functions import ids, text
from quarry.functions import vectors as V
from quarry.operators import als, clustering, forest, lsh, normalize, sampling, summary
from quarry.plans.generation import AppendLog, Generations, Reloading, Runner
from quarry.plans.requests import ClusterRequests, ForestRequests, Requests, lines, status
from quarry.plans.serving import PairRescorer, Recommender, Rescorer, RescorerProvider, load, sign_candidates
from quarry.plans.vectors import RowVectors
from quarry.sources import models, tables
from quarry.streaming import flows


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, float(i % 10) if i % 17 else None, ["a b", "c", 'd"e', None][i % 4], "yes" if i % 10 >= 5 else "no", float(i % 10 >= 5) * 3 + (i % 4 == 1)) for i in range(600)]
    return spark.createDataFrame(rows, "id long, x double, c string, y string, z double")


def test_forests_of_both_kinds_and_their_files(spark, labelled):
    f = forest.build(labelled, "y", ["x"], ["c"], ForestSettings(trees=3, feature_fraction=1.0))
    assert forest.evaluate(f.predict(labelled), "y", True).first().accuracy > 0.96
    g = forest.build(labelled, "z", ["x"], ["c"], ForestSettings(trees=3, feature_fraction=1.0), classification=False)
    assert forest.evaluate(g.predict(labelled), "z", False).first().rmse < 0.5
    assert {n.feature for nodes in g.trees for n in nodes.values()} == {"x", "c", None}
    for model in (f, g):
        back = models.forest_from_pmml(models.forest_to_pmml(model))
        assert back.weights == model.weights and back.classes == model.classes
        assert [r.prediction for r in back.predict(labelled).orderBy("id").collect()] == [r.prediction for r in model.predict(labelled).orderBy("id").collect()]
    both = f.merged(f)
    assert len(both.trees) == 6 and both.predict(labelled).where("prediction = y").count() == f.predict(labelled).where("prediction = y").count()
    leaf = next(n for n in f.trees[0].values() if n.feature is None)
    odd = spark.createDataFrame([(None, "never seen")], "x double, c string")
    assert f.predict(odd).count() == 1 and leaf.counts


def test_forest_decisions_are_one_thing_in_numpy_and_spark(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (5.0, None), (3.0, "c")], "x double, c string")
    for n in (forest.Node("r", feature="x", threshold=3.0, default=False), forest.Node("r", feature="c", categories=["a", "b"], default=True)):
        got = [r.s for r in df.select(n.condition().alias("s")).collect()]
        assert n.side(df.toPandas()[n.feature].to_numpy(dtype=float if n.threshold else object, na_value=np.nan if n.threshold else None)).tolist() == got


def test_hot_rows_of_a_half_step(spark):
    rng = np.random.default_rng(3)
    y = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(50)], "item_id long, features array<double>")
    r = spark.createDataFrame([(u, i, float(1 + (u + i) % 5)) for u in range(4) for i in range(50 if u == 0 else 3)], "user_id long, item_id long, value double")
    s = RecommenderSettings(features=4)
    whole = {q.user_id: q.features for q in als.half_step(r, y, s).collect()}
    split = {q.user_id: q.features for q in als.half_step(r, y, s, hot_rows=7).collect()}
    assert whole.keys() == split.keys() and all(np.allclose(whole[u], split[u], atol=1e-5) for u in whole)
    assert np.isfinite(als._solved(np.zeros((2, 2)), 0.0, np.ones((2, 2)), np.ones(2), 1)).all()


def test_factors_by_the_operator_itself(spark):
    """Both sides in turn on DataFrames, against the same steps in numpy."""
    r = spark.createDataFrame([(0, 1, 2.0), (0, 2, 3.0), (0, 3, 1.0), (1, 2, 4.0), (1, 3, 5.0), (2, 0, 1.0), (2, 4, 2.0), (3, 0, 3.0), (3, 2, 1.0), (3, 4, 5.0), (4, 1, 2.0), (4, 2, 2.0), (4, 3, 2.0)], "user_id long, item_id long, value double")
    y0 = [[0.1, 0.2], [0.2, 0.5], [0.3, 0.1], [0.2, 0.2], [0.5, 0.4]]
    start = spark.createDataFrame([(i, v) for i, v in enumerate(y0)], "item_id long, features array<double>")
    x, y, done = als.factorize(r, RecommenderSettings(features=2, max_iterations=6, convergence_threshold=1e-9), start)
    m = np.zeros((5, 5))
    for q in r.collect():
        m[q.user_id, q.item_id] = q.value
    a, b = None, np.array(y0)
    s = RecommenderSettings(features=2)
    for _ in range(done):
        half = lambda mat, o: np.array([als._solved(o.T @ o, 0.1, *als.normal_parts(row[row != 0], o[row != 0], s), int((row != 0).sum())) for row in mat], float)
        a = half(m, b)
        b = half(m.T, a)
    got = np.array([q.features for q in x.orderBy("user_id").collect()]) @ np.array([q.features for q in y.orderBy("item_id").collect()]).T
    assert np.allclose(got, a @ b.T, atol=1e-4)


def test_new_and_first_vectors(spark):
    r = spark.createDataFrame([(4, 1, 1.0), (4, 2, 1.0), (5, 8, 1.0)], "user_id long, item_id long, value double")
    old = spark.createDataFrame([(1, [0.5])], "item_id long, features array<float>")
    got = {q.item_id: list(q.features) for q in als.first_vectors(als.new_items(r), old).collect()}
    assert got == {1: [0.5], 2: [], 8: []}
    assert [tuple(q)[:2] for q in als.sampled(r, 2).collect()] == [(4, 2)]


@pytest.fixture
def model(spark):
    y = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "item_id long, features array<float>")
    x = spark.createDataFrame([(7, [1.0, 0.5])], "user_id long, features array<float>")
    r = spark.createDataFrame([(7, 0, 1.0)], "user_id long, item_id long, value double")
    return Recommender(x, y, r)


def test_requests(model):
    ask = Requests(model).handle
    assert [tuple(q) for q in ask("GET", "/recommend/7?howMany=1").collect()] == [(2, 1.5)]
    assert [q.line for q in lines(ask("GET", "/recommend/7?considerKnownItems=true")).collect()] == ["2,1.5", "0,1.0", "1,0.5"]
    assert {q.item_id for q in ask("GET", "/recommendToMany/7/99").collect()} == {1, 2}
    assert ask("GET", "/recommendToAnonymous/0/1=2").first().item_id == 2
    assert ask("GET", "/similarity/0").first().item_id == 2
    assert ask("GET", "/similarityToItem/0/2").first().value == pytest.approx(0.5**0.5)
    assert {q.item_id: q.value for q in ask("GET", "/estimate/7/1/50").collect()} == {1: 0.5, 50: 0.0}
    assert ask("GET", "/estimateForAnonymous/2/0").count() == 1 and ask("GET", "/because/7/2").first().item_id == 0
    assert ask("GET", "/mostPopularItems").first().item_id == 0 and ask("HEAD", "/ready") is True
    for method, path, code in (("GET", "/recommend/7?howMany=x", 400), ("GET", "/recommend", 400), ("GET", "/recommend/8", 404), ("GET", "/similarity/80", 404), ("GET", "/nothing", 404)):
        with pytest.raises(Exception) as e:
            ask(method, path)
        assert status(e.value) == code
    with pytest.raises(Exception) as e:
        Requests(Recommender()).handle("GET", "/ready")
    assert status(e.value) == 503
    ask("POST", "/ingest", "7,1,2\n9,1\n")
    assert {tuple(q) for q in model.r.collect()} == {(7, 0, 1.0), (7, 1, 2.0), (9, 1, 1.0)}
    model.read_only = True
    with pytest.raises(LookupError):
        Requests(model).handle("POST", "/pref/7/1")


def test_preferences_move_vectors_at_once(spark, model, tmp_path):
    before = model.estimate(7, [1]).first().value
    Requests(model).handle("POST", "/pref/7/1", "3")
    assert model.estimate(7, [1]).first().value > before and {q.item_id for q in model.r.collect()} == {0, 1}
    Requests(model).handle("POST", "/pref/42/1")
    assert model.x.where("user_id = 42").count() == 1
    Requests(model).handle("DELETE", "/pref/42/1")
    assert model.x.where("user_id = 42").count() == 0
    g = Generations(spark, f"file://{tmp_path}/m")
    assert not model.refresh(g)
    model.save(g, g.open_next())
    g.finish(0, {})
    model.recent = [(50, 2, 1.0)]
    assert model.refresh(g) and model.x.where("user_id = 50").count() == 1 and model.recent == [(50, 2, 1.0)]


class Provider(RescorerProvider):
    def for_recommend(self, users, *args):
        return Rescorer(is_filtered=lambda i: i.isin(*map(int, args))) if args else None

    def for_most_similar(self, *args):
        return PairRescorer(lambda a, i, v: v * 2, lambda a, i: (a == 0) & (i == 2))


def test_rescorers_and_candidates(model):
    model.provider = load(f"{__name__}:Provider")
    assert [q.item_id for q in Requests(model).handle("GET", "/recommend/7?rescorerParams=2").collect()] == [1]
    assert {q.item_id: q.value for q in model.most_similar([0]).collect()} == {1: 0.0}
    assert model.most_similar([0, 1]).first().value == pytest.approx(2 * 0.5**0.5)
    model.candidates = sign_candidates(model.y, 1.0)
    assert [q.item_id for q in model.recommend(7).collect()] == [2, 1]


def test_sign_bits_find_what_scores_best(spark):
    """Recall and share of a tenth of the items, over unit vectors."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(4000, 30))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    index = lsh.SignIndex(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item_id long, features array<double>"), 30, 20, 0.1)
    recall, share = [], []
    for q in v[:8]:
        got = {r.item_id for r in index.candidates(q.tolist()).select("item_id").collect()}
        best = set(np.argsort(-(v @ q))[:10].tolist())
        recall.append(len(got & best) / 10)
        share.append(len(got) / len(v))
    assert np.mean(recall) > 0.45 and np.mean(share) < 0.13


def test_rows_to_vectors_and_clusters(spark):
    df = spark.createDataFrame([(0, 1.0, "a"), (1, 3.0, "b"), (2, 5.0, "a")], "id long, n double, c string")
    stats, levels = summary.counted(df, ["n"]), summary.levels(df, ["c"])
    rows = RowVectors(["id", "n", "c"], stats, levels, {"n": "z"}, {"c": 2.0})
    want = {r.id: list(r.vec) for r in normalize.standardize(df, ["n"], ["c"], {"n": "z"}, {"c": 2.0}, ["id"]).collect()}
    assert all(np.allclose(rows.vector([str(i), n, c]), want[i]) for i, n, c in ((0, "1", "a"), (1, "3", "b"), (2, "5", "a")))
    assert rows.vector(["0", "", "a"]) is None and rows.vector(["0", "1", "new"])[1:] == [0.0, 0.0] and not rows.sparse()
    kept = []
    ask = ClusterRequests(rows, [want[0], want[1]], kept.extend).handle
    assert ask("GET", "/assign/9,3,b") == 1 and ask("GET", "/distanceToNearest/9,1,a") == pytest.approx(0)
    with pytest.raises(ValueError):
        ask("GET", "/assign/9,3")
    ask("POST", "/add", "1,2,a\n\n")
    assert kept == ["1,2,a"]
    settings = InboundSettings(("id", "n", "c"), numeric=(1,), ids=(0,), target=2)
    pmml = models.clusters_to_pmml(["n", "c"], [[1.0, 2.5]], [3], settings)
    assert models.clusters_from_pmml(pmml) == [(["n", "c"], [[1.0, 2.5]])] and models.read_dictionary(pmml)["n"][0] == "continuous"
    assert models.factors_from_pmml(models.factors_to_pmml({"x": "a/x", "y": "b y"})) == {"x": "a/x", "y": "b y"}
    with pytest.raises(summary.TooManyLevels):
        summary.levels(df, ["c"], 1)


def test_forest_requests(spark, labelled):
    f = forest.build(labelled, "y", ["x"], ["c"], ForestSettings(trees=1, feature_fraction=1.0))
    ask = ForestRequests(spark, f, ["x", "c", "y"], ["x"]).handle
    assert ask("GET", "/classify/9,c,") == "yes" and ask("GET", "/classify/1,%22never%22,") == "no"
    before = sum(sum(n.counts) for n in f.trees[0].values() if n.feature is None)
    ask("POST", "/train", "9,c,yes\n1,c,no\n")
    assert sum(sum(n.counts) for n in f.trees[0].values() if n.feature is None) == before + 2


def test_centre_index_and_several_sets(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(40, 12)) * 5
    points = centers[rng.integers(0, 40, 500)] + rng.normal(size=(500, 12)) * 0.1
    index = clustering.CenterIndex([centers[:5], centers])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, vec array<double>")
    want = clustering.distances(points, centers).argmin(1)
    for exact in (True, False):
        got = np.array([r.center_id for r in index.assign(df, 1, exact).orderBy("id").collect()])
        assert (got == want).mean() > 0.99
    many = clustering.lloyd_many(df, [centers[:3].tolist(), centers[:7].tolist()], 2)
    for k, m in zip((3, 7), many):
        assert np.allclose(m, clustering.update_lloyd(points, np.ones(500), centers[:k], 2))
    cov = {(r.i, r.j): r.cov for r in clustering.covariance(df.withColumn("center_id", F.lit(0)), 12).collect()}
    assert np.allclose([cov[i, j] for i, j in sorted(cov)], np.cov(points.T, bias=True)[np.triu_indices(12)])
    far = clustering.outliers(clustering.assign(df, centers), clustering.covariance(clustering.assign(df, centers), 12), 12)
    assert far.where("mahalanobis < 0").count() == 0
    stats, chosen, models_ = clustering.select_k(df, ClusterSettings(ks=(2, 5), replications=1))
    assert len(stats) == 2 and len(chosen) >= 1
    one, two = clustering.result_tables(spark, stats, chosen, models_)
    assert one.where("chosen").count() == len(chosen) and two.count() == 7


def test_append_log_and_settled_input(spark, tmp_path):
    g = Generations(spark, f"file://{tmp_path}/m")
    log = AppendLog(g, 2)
    log.append("1,2")
    assert g.every() == []
    log.append("3,4,5")
    assert sorted(r.value for r in tables.read_lines(spark, f"file://{tmp_path}/m/00000/inbound").collect()) == ["1,2", "3,4,5"] and log.roll() is None
    assert g.settled(0)
    g.store.touch("00000/inbound/_x.inprogress")
    assert not g.settled(0) and g.settled(0, -1) and g.settled(0)
    now, made = [0.0], []
    r = Reloading(lambda: made.append(1) or 1 // (2 - len(made)) and len(made), 10, lambda: now[0])
    assert r.get() == 1 and r.get() == 1
    now[0] = 11
    assert r.get() == 1 and r.failed == 1 and r.due == 31


def test_lines_in_order_and_streams_that_restart(spark, tmp_path):
    import os

    for k, name in enumerate(("b", "a")):
        (tmp_path / f"{name}.csv").write_text("".join(f"{name}{i}\n" for i in range(5)))
        os.utime(tmp_path / f"{name}.csv", (1000 + k, 1000 + k))
    got = [r.value for r in tables.read_lines_in_order(spark, f"file://{tmp_path}").orderBy("seq").collect()]
    assert got == [f"{n}{i}" for n in "ba" for i in range(5)]
    at, schema = f"file://{tmp_path}/s", "user_id long, item_id long, value double, is_delete boolean"
    merge = lambda: sorted(map(tuple, flows.merge_stream(spark, f"{at}/in", schema, f"{at}/state", f"{at}/check").collect()))
    for rows, want in (([(1, 1, 2.0, False)], [(1, 1, 2.0)]), ([(1, 1, None, True), (2, 2, 1.0, False)], [(2, 2, 1.0)]), ([(2, 2, 1.0, False)], [(2, 2, 2.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        assert merge() == want and merge() == want  # again, without new files


def test_files_round_trip(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.csv", "1,2\n3,4\n")
        z.writestr("two.csv", "5,é\n")
    assert sorted(r.value for r in tables.read_zipped_lines(spark, f"file://{tmp_path}").collect()) == ["1,2", "3,4", "5,é"]
    df = spark.createDataFrame([(1, 'a,"b"', 2.5), (2, "", None)], "id long, s string, x double")
    tables.write_delimited(df, f"file://{tmp_path}/csv")
    back = tables.read_delimited(spark, f"file://{tmp_path}/csv", "id long, s string, x double").orderBy("id").collect()
    assert [(r.id, r.s, r.x) for r in back] == [(1, 'a,"b"', 2.5), (2, None, None)]
    f = spark.createDataFrame([(5, [0.5, -1.0])], "item_id long, features array<float>")
    tables.write_factors(f, f"file://{tmp_path}/y", "item_id")
    assert tables.read_factors(spark, f"file://{tmp_path}/y", "item_id").collect() == f.collect()
    (tmp_path / "known.txt").write_text("7\t1,2\n")
    assert list(tables.read_known_items(spark, f"file://{tmp_path}/known.txt").first()) == [7, [1, 2]]


def test_runner(spark, tmp_path):
    now, g = [0.0], Generations(spark, f"file://{tmp_path}/m")
    r = Runner(g, lambda k: {"built": k}, GenerationSettings(keep=1, time_threshold_minutes=5), lambda: now[0])
    assert r.tick() == 0 and r.tick() is None
    r.force_run()
    assert r.tick() == 1 and r.tick() is None and g.every() == [1, 2]
    now[0] = 600.0
    assert r.tick() == 2
    r.interrupt()
    r.force_run()
    assert r.tick() is None


def test_small_functions(spark):
    df = spark.createDataFrame([("1,a,,", [0.0, 0.0, 2.0, 0.0, 0.0], 1.0, 2.0), ("x", [1.0, 2.0], None, 1.0), ("y", [], 4.0, 6.0)], "line string, v array<double>, x double, w double")
    assert df.select(text.split_plain(F.col("line")).alias("f")).first().f == ["1", "a", "", ""]
    assert df.select(text.join_plain([F.col("line"), F.col("x")]).alias("s")).collect()[1].s == "x,"
    got = df.select(V.to_text(F.col("v")).alias("t"), V.from_text(V.to_text(F.col("v"))).alias("v")).collect()
    assert got[0].t == "5:2=2.0" and got[0].v == [0.0, 0.0, 2.0, 0.0, 0.0] and got[1].v == [1.0, 2.0]
    assert df.agg(V.weighted_mean(F.col("x"), F.col("w")).alias("m")).first().m == pytest.approx(26 / 8)
    names = ids.read_mapping(spark.createDataFrame([("5,a,b",), ("bad",)], "value string")).collect()
    assert [tuple(r) for r in names] == [(5, "a,b")] and ids.collisions(df, "line").count() == 0
    assert [(r.level, r.id) for r in forest.category_ids(df, ["line"]).orderBy("id").collect()] == [("1,a,,", 0), ("x", 1), ("y", 2)]
    draws = sampling.weighted_draws(spark.range(50).withColumn("w", F.when(F.col("id") == 3, 50.0).otherwise(1.0)), 400, "id", "w")
    assert draws.count() == 400 and 120 < draws.where("id = 3").count() < 280
    assert 0 < sampling.bernoulli(spark.range(200), 0.3, "id").count() < 120
