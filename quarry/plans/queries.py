"""Registered queries of the engine, each with SQL that DuckDB can run."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import ClusterSettings, ForestSettings, RecommenderSettings
from ..functions import ids, random, text
from ..functions import vectors as V
from ..operators import als, blocks, clustering, forest, lsh, normalize, preferences, recommend, sampling, summary, topk
from ..streaming import flows
from .serving import Rescorer
from .storage import cut_lineage, dealt, shared_folder

DIM = 64  # elements of a vector
CENTERS = 5


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark, d, by_pair: bool = True) -> DataFrame:
    """Lines with their orders, in tasks of bounded rows, dealt by what preferences are grouped by."""
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = load(spark, d, "lineitem")
    rows = lines.count()
    both = dealt(lines, rows, "l_orderkey").join(dealt(orders, rows, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return dealt(both, rows, "o_custkey", "l_partkey") if by_pair else both


def prefs(spark, d) -> DataFrame:
    return _lines(spark, d).groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id")).agg(F.sum("l_quantity").alias("value"))


PREFS = "prefs as (select o_custkey user_id, l_partkey item_id, sum(l_quantity) as value from lineitem join orders on l_orderkey = o_orderkey group by 1, 2)"
SPLIT = "1996-01-01"


def _generations(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = _lines(spark, d).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), F.col("l_quantity").alias("value"), (F.col("l_returnflag") == "R").alias("is_delete"), "o_orderdate")
    old = rows.where(F.col("o_orderdate") < F.lit(SPLIT).cast("timestamp")).groupBy("user_id", "item_id").agg(F.sum("value").alias("value"))
    return old, rows.where(F.col("o_orderdate") >= F.lit(SPLIT).cast("timestamp")).drop("o_orderdate")


def _merge_sql(decay: float, threshold: float) -> str:
    return f"""with lines as (select o_custkey user_id, l_partkey item_id, l_quantity v, l_returnflag = 'R' del, o_orderdate < timestamp '{SPLIT}' old from lineitem join orders on l_orderkey = o_orderkey),
 g as (select user_id, item_id, coalesce(sum(case when old then v end), 0) before, coalesce(sum(case when not old and not del then v end), 0) added, coalesce(bool_or(case when not old then del end), false) deleted from lines group by 1, 2),
 m as (select user_id, item_id, round(case when deleted then 0 else before * {decay} end + added, 4) as value from g)
 select * from m where abs(value) > {threshold}"""


def _both_generations(spark, d) -> DataFrame:
    """The rows of both generations as one table, read once."""
    old, deleted = F.col("o_orderdate") < F.lit(SPLIT).cast("timestamp"), F.col("l_returnflag") == "R"
    value = F.col("l_quantity").cast("double")
    columns = (F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), F.when(old, value).alias("before"), F.when(~old & ~deleted, value).alias("added"), (~old & deleted).alias("is_delete"))
    return _lines(spark, d).where(old | ~old).select(*columns)  # a line without a date is in neither


def pref_merge(spark, d):
    return preferences.merged(_both_generations(spark, d)).withColumn("value", F.round("value", 4))


def pref_merge_decay(spark, d):
    return preferences.merged(_both_generations(spark, d), 0.5, 5.0).withColumn("value", F.round("value", 4))


def pref_merge_in_order(spark, d):
    rows = _lines(spark, d).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), F.col("l_quantity").alias("value"), (F.col("l_returnflag") == "R").alias("is_delete"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return preferences.merge_in_order(rows).withColumn("value", F.round("value", 4))


def most_popular_items(spark, d):
    return topk.top(preferences.popularity(prefs(spark, d)), 10)


def known_items(spark, d):
    return preferences.known_items(prefs(spark, d)).select("user_id", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


def item_vectors(spark, d):
    v = preferences.vectors(prefs(spark, d), "item_id", "user_id")
    return v.select("item_id", F.array_join(F.transform("entries", lambda e: F.concat(e["id"].cast("string"), F.lit(":"), e["value"].cast("long").cast("string"))), ",").alias("entries"))


def id_mapping(spark, d):
    users = load(spark, d, "customer").select(F.concat(F.lit("u"), F.col("c_custkey")).alias("user"), F.col("c_custkey").cast("string").alias("item"))
    return ids.mapping(users, "user", "item")


def topk_per_user(spark, d):
    return topk.top_per_group(prefs(spark, d), 3, ["user_id"], rank="rank")


def common_known_items(spark, d):
    return preferences.known_to_all(prefs(spark, d), [34, 58])


def prune_stale(spark, d):
    old, new = _generations(spark, d)
    rows = load(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return preferences.prune_stale(rows, new.where("value > 45"), old.where("value > 90"), "user_id")


def _items(spark, d) -> DataFrame:
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("features"))


def _users(spark, d) -> DataFrame:
    """A user is the first vector its id points at: fixed factors for queries."""
    n = F.broadcast(load(spark, d, "embeddings").agg(F.count("*").alias("_n")))
    base = load(spark, d, "customer").select(F.col("c_custkey").alias("user_id")).join(n)
    items = _items(spark, d)
    return base.join(items, F.pmod(F.col("user_id") * 7, F.col("_n")) == F.col("item_id")).select("user_id", "features")


USERS = "users as (select c_custkey user_id, embedding x from customer join embeddings on (c_custkey * 7) % (select count(*) from embeddings) = vec_id)"


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::double * p[2]::double))"


def _cos(a: str, b: str) -> str:
    return f"({_dot(a, b)} / sqrt({_dot(a, a)} * {_dot(b, b)}))"


def gram_matrix(spark, d):
    g = blocks.gram(_items(spark, d))
    return spark.createDataFrame([(i, j, round(float(g[i, j]), 4)) for i in range(len(g)) for j in range(len(g))], "i int, j int, v double")


def item_similarity_topk(spark, d):
    return recommend.similar_items(_items(spark, d), 5).select(F.col("user_id").alias("from_id"), "item_id", F.round("value", 6).alias("value"))


def similarity_to_item(spark, d):
    return recommend.similarity_to_item(_items(spark, d), 3, [0, 1, 2, 10**9]).withColumn("value", F.round("value", 6))


def most_similar_items(spark, d):
    return recommend.most_similar(_items(spark, d), [1, 2], 10).withColumn("value", F.round("value", 6))


def recommended_because(spark, d):
    pairs = load(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(5).cast("long").alias("to_item"))
    out = recommend.because(prefs(spark, d), _items(spark, d), pairs, 3)
    return out.select("user_id", "item_id", F.round("value", 6).alias("value"))


def recommend_all(spark, d):
    out = recommend.recommend_all(_users(spark, d), _items(spark, d), prefs(spark, d), 5)
    return out.withColumn("value", F.round("value", 6))


def recommend_to_many(spark, d):
    return recommend.recommend_to_many(_users(spark, d), _items(spark, d), prefs(spark, d), [1, 2, 3], 10).withColumn("value", F.round("value", 6))


def rescored_recommend(spark, d):
    r = Rescorer(lambda i, v: F.when(i % 2 == 0, v * 2).otherwise(v), lambda i: i % 5 == 0)
    return recommend.recommend(_users(spark, d), _items(spark, d), prefs(spark, d), 1, 10, rescore=r).withColumn("value", F.round("value", 6))


def estimate_preferences(spark, d):
    pairs = dealt(prefs(spark, d).select("user_id", "item_id"), load(spark, d, "lineitem").count(), "user_id")
    return recommend.estimates(pairs, _users(spark, d), _items(spark, d)).withColumn("value", F.round("value", 6))


def fold_in_weight(spark, d):
    e = load(spark, d, "events")
    value = (F.pmod("event_id", F.lit(11)) - 5).cast("double")
    estimate = (F.pmod("event_id", F.lit(7)) / 4 - 0.5).cast("double")
    return e.select("event_id", F.round(recommend.fold_in_weight(estimate, value), 8).alias("w"))


def recommend_to_anonymous(spark, d):
    return recommend.recommend_to_anonymous(_items(spark, d), [1, 2, 3], [1.0, 2.0, 3.0], 10).withColumn("value", F.round("value", 6))


def column_summary(spark, d):
    s = summary.numeric_summary(load(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return s.select("column", "n", "missing", *(F.round(c, 4).alias(f"x_{c}") for c in ("min", "max", "mean", "stddev")))


def category_histogram(spark, d):
    return summary.histogram(load(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


def _transformed(kind: str):
    def query(spark, d):
        part = load(spark, d, "part")
        s = summary.counted(part, ["p_retailprice"])["p_retailprice"]
        return part.select("p_partkey", F.round(normalize.transform(F.col("p_retailprice"), kind, s), 6).alias("v"))

    return query


def one_hot(spark, d):
    c = load(spark, d, "customer")
    vec = normalize.standardize(c.select("c_custkey", "c_acctbal", "c_mktsegment"), ["c_acctbal"], ["c_mktsegment"], ids=["c_custkey"])
    return vec.select("c_custkey", F.array_join(F.transform("vec", lambda x: F.round(x * 100).cast("long").cast("string")), ",").alias("vec"))


def _points(spark, d) -> DataFrame:
    return load(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))


def _centers(spark, d) -> list[list[float]]:
    return [list(r["vec"]) for r in _points(spark, d).where(F.col("vec_id") < CENTERS).orderBy("vec_id").collect()]


ASSIGN = f"""pts as (select vec_id, label, list_transform(embedding, lambda x: x::double) v from embeddings),
 dist as (select p.vec_id, p.label, p.v, c.vec_id cid, list_sum(list_transform(list_zip(p.v, c.v), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) sq from pts p, (select * from pts where vec_id < {CENTERS}) c),
 asg as (select vec_id, label, v, arg_min(cid, (sq, cid)) cid, min(sq) sq from dist group by 1, 2, 3)"""


def assign_nearest(spark, d):
    return clustering.assign(_points(spark, d), _centers(spark, d)).select("vec_id", F.col("center_id").cast("long").alias("center_id"), F.round("sq", 6).alias("sq"))


def lloyd_step(spark, d):
    c = clustering.centroids(clustering.assign(_points(spark, d), _centers(spark, d)), DIM)
    return c.select(F.col("center_id").cast("long").alias("center_id"), F.col("n").cast("long").alias("n"), F.posexplode("centroid").alias("i", "x")).withColumn("x", F.round("x", 6))


def cluster_cost(spark, d):
    return clustering.assign(_points(spark, d), _centers(spark, d)).agg(F.count("*").alias("n"), F.round(F.sum("sq"), 3).alias("cost"))


def contingency_vi_vd(spark, d):
    a = clustering.assign(_points(spark, d), _centers(spark, d)).groupBy("center_id", "label").count().collect()
    rows, cols = sorted({r["center_id"] for r in a}), sorted({r["label"] for r in a})
    table = np.zeros((len(rows), len(cols)))
    for r in a:
        table[rows.index(r["center_id"]), cols.index(r["label"])] = r["count"]
    vd, vi = clustering.agreement(table)
    return spark.createDataFrame([(round(float(vd), 6), round(float(vi), 6))], "vd double, vi double")


def cluster_covariance(spark, d):
    c = clustering.covariance(clustering.assign(_points(spark, d), _centers(spark, d)), DIM)
    return c.select(F.col("center_id").cast("long").alias("center_id"), "i", "j", (F.round("cov", 5) + 0.0).alias("cov"))


def outlier_scores(spark, d):
    a = clustering.assign(_points(spark, d), _centers(spark, d))
    return clustering.outliers(a, clustering.covariance(a, DIM), DIM).select("vec_id", "center_id", "sq", "euclidean", "mahalanobis")


def kmeans_select_k(spark, d):
    stats, chosen, _ = clustering.select_k(_points(spark, d), ClusterSettings(ks=(2, 5, 10), replications=2), key="vec_id")
    picked = {(v.k, v.replica) for v in chosen}
    return spark.createDataFrame([(v.k, v.replica, v.cost, v.van_dongen, v.variation_of_information, (v.k, v.replica) in picked) for v in stats], "k int, replica int, cost double, vd double, vi double, chosen boolean")


def kfold_assign(spark, d):
    return sampling.with_fold(load(spark, d, "customer").select("c_custkey"), 5, "c_custkey")


def weighted_sample(spark, d):
    return sampling.weighted_sample(load(spark, d, "part").select("p_partkey", "p_size", "p_brand"), 2, "p_partkey", "p_size", group=["p_brand"])


def tree_fold_assign(spark, d):
    c = load(spark, d, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("tree"))
    return c.where(sampling.in_tree(F.col("c_custkey"), F.col("tree"), 5, 3))


def als_normal_equations(spark, d):
    """Each user's right-hand side and the sums of the rows of the whole matrix."""
    r = cut_lineage(prefs(spark, d), "ratings")
    sums = lambda users, n, w, b: [pa.array(users), pa.array(n), als.lists(b), als.lists(w.sum(axis=2))]
    hot = als.hot_users(r)
    parts = als.normal_equations(r, _items(spark, d), RecommenderSettings(alpha=0.1), hot, sums, "user_id long, n long, b array<double>, w array<double>", r.count())
    rows = parts.select("user_id", "n", F.posexplode(F.arrays_zip("b", "w")).alias("i", "z")).select("user_id", "n", "i", "z.b", "z.w")
    if hot is not None:
        rows = rows.groupBy("user_id", "i").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.sum("w").alias("w"))
    return rows.select("user_id", "n", "i", (F.round("b", 3) + 0.0).alias("b"), (F.round("w", 3) + 0.0).alias("w"))


def als_factors(spark, d):
    s = RecommenderSettings(features=10, max_iterations=3)
    x, _, _ = als.factorize(prefs(spark, d), s)
    return x


def als_convergence(spark, d):
    """The stopping metric between two sets of scores."""
    p = prefs(spark, d)
    return als.convergence(p.withColumn("value", F.col("value") * 0.9), p).select(F.round("change", 6).alias("change"))


def _signatures(spark, d) -> DataFrame:
    signs = lsh.planes(16, 64)
    return _items(spark, d).select("item_id", lsh.signature(F.transform("features", lambda x: F.round(x * 1000).cast("double")), [0.0] * 64, signs).alias("signature"))


def _signature_sql() -> str:
    bits = [f"case when list_sum(list_transform(list_zip(embedding, {p}), lambda q: round(q[1]::double * 1000) * q[2])) > 0 then {1 << h} else 0 end" for h, p in enumerate(lsh.planes(16, 64))]
    return f"select vec_id item_id, ({' + '.join(bits)})::bigint signature from embeddings"


def lsh_signature(spark, d):
    return _signatures(spark, d)


def lsh_candidates(spark, d):
    s = _signatures(spark, d)
    asked = s.where("item_id % 20 = 0").select(F.col("item_id").alias("asked"), "signature")
    return lsh.near(asked, s, lsh.max_distance(16, 0.1))


def class_entropy(spark, d):
    c = forest.class_counts(load(spark, d, "lineitem"), ["l_shipdate"], "l_returnflag", ["A", "N", "R"])
    return c.select(F.col("l_shipdate").cast("date").cast("string").alias("day"), F.round(forest.entropy_of("stats"), 6).alias("entropy"))


def split_gain_categorical(spark, d):
    """Gain for the class of the return flag at every quantity."""
    cells = forest.class_counts(load(spark, d, "lineitem"), ["l_quantity"], "l_returnflag", ["A", "N", "R"])
    gains = forest.gains(cells.select(F.lit(0).alias("node"), F.col("l_quantity").alias("x"), "stats"), ["node"], ["A", "N", "R"])
    return gains.select(F.col("x").alias("l_quantity"), F.round("gain", 8).alias("gain"))


def split_gain_numeric(spark, d):
    """Half log-variance gain for the tax at every quantity."""
    li = load(spark, d, "lineitem").withColumn("y", F.round(F.col("l_tax") * 100))
    cells = forest.class_counts(li, ["l_quantity"], "y", None)
    gains = forest.gains(cells.select(F.lit(0).alias("node"), F.col("l_quantity").alias("x"), "stats"), ["node"], None)
    return gains.where("gain is not null").select(F.col("x").alias("l_quantity"), F.round("gain", 8).alias("gain"))


def weighted_vote(spark, d):
    votes = load(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("class"), F.col("l_quantity").alias("weight"), F.lit(1.0).alias("probability"))
    return forest.vote(votes, "l_orderkey")


def rmse_accuracy(spark, d):
    li = load(spark, d, "lineitem")
    a = forest.evaluate(li.withColumn("prediction", F.when(F.col("l_quantity") > 25, "N").otherwise("A")), "l_returnflag", True)
    b = forest.evaluate(li.withColumn("prediction", F.lit(25.0)), "l_quantity", False)
    return a.join(b.drop("n")).select("n", F.round("accuracy", 8).alias("accuracy"), F.round("rmse", 6).alias("rmse"), F.round("mean_abs", 6).alias("mean_abs"))


def forest_build(spark, d):
    s = ForestSettings(trees=3, feature_fraction=1.0, max_depth=5, min_node_size=20)
    part = load(spark, d, "part").withColumn("big", F.when(F.col("p_retailprice") > 1400, "y").otherwise("n"))
    f = forest.build(part, "big", ["p_size", "p_retailprice"], ["p_brand"], s, key="p_partkey")
    return forest.evaluate(f.predict(part), "big", True)


def decision_predicates(spark, d):
    c = load(spark, d, "customer").withColumn("positive", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")))
    numeric = forest.Node("r", feature="positive", threshold=4500.0, default=True).condition()
    level = forest.Node("r", feature="c_mktsegment", categories=["BUILDING", "MACHINERY"], default=False).condition()
    return c.select("c_custkey", numeric.alias("numeric_side"), level.alias("level_side"))


def csv_round_trip(spark, d):
    c = load(spark, d, "customer").select("c_custkey", F.concat(F.col("c_name"), F.lit(',"x" ')).alias("a"), F.lit("").alias("b"))
    line = c.select("c_custkey", text.encode_delimited([F.col("a"), F.col("b"), F.col("c_custkey")]).alias("line"))
    back = text.decode_delimited(F.col("line"), 3)
    return line.select("c_custkey", "line", back[0].alias("a"), back[1].alias("b"), back[2].alias("c"))


def events_hourly_stats(spark, d):
    s = flows.windowed_stats(load(spark, d, "events"))
    return s.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("mean", 4).alias("mean"), F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


def sliding_hour_stats(spark, d):
    """For each event, the hour up to it, by type."""
    out = flows.trailing_stats(load(spark, d, "events"))
    return out.select("event_id", "n", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


STREAM_CUTS = ("1994-01-01", "1996-01-01")


def stream_merge(spark, d):
    """A stream that is started as files arrive: those of each span of order dates are one batch."""
    import uuid

    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    day = F.col("o_orderdate")
    spans = F.when(day < F.lit(STREAM_CUTS[0]).cast("timestamp"), 0).when(day < F.lit(STREAM_CUTS[1]).cast("timestamp"), 1).otherwise(2)
    rows = _lines(spark, d, by_pair=False).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), F.col("l_quantity").alias("value"), (F.col("l_returnflag") == "R").alias("is_delete"), spans.alias("span"))
    rows = cut_lineage(rows, "lines")
    for k in range(3):
        rows.where(F.col("span") == k).drop("span").write.mode("append").parquet(f"{at}/inbound")
        out = flows.merge_stream(spark, f"{at}/inbound", "user_id long, item_id long, value double, is_delete boolean", f"{at}/state", f"{at}/checkpoint", files=None)
    return out.withColumn("value", F.round("value", 4))


def unit_vectors(spark, d):
    """Starting factors by hash of the id; all of length one."""
    y = als.initial_factors(load(spark, d, "part").select(F.col("p_partkey").alias("item_id")), 10)
    return y.select("item_id", F.round(V.norm(F.col("features")), 4).alias("length"))


def uniform_draws(spark, d):
    return load(spark, d, "customer").select("c_custkey", random.uniform(F.col("c_custkey"), 7).alias("u"))


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {f.__name__: f for f in (
    most_popular_items, pref_merge, pref_merge_decay, pref_merge_in_order, known_items, item_vectors, id_mapping, topk_per_user, common_known_items, prune_stale,
    gram_matrix, item_similarity_topk, similarity_to_item, most_similar_items, recommended_because, recommend_all, recommend_to_many, rescored_recommend, estimate_preferences, fold_in_weight, recommend_to_anonymous,
    column_summary, category_histogram, one_hot, assign_nearest, lloyd_step, cluster_cost, contingency_vi_vd, cluster_covariance, outlier_scores, kmeans_select_k, kfold_assign, weighted_sample, tree_fold_assign,
    als_normal_equations, als_factors, als_convergence, lsh_signature, lsh_candidates, class_entropy, split_gain_categorical, split_gain_numeric, weighted_vote, rmse_accuracy, forest_build, decision_predicates,
    csv_round_trip, events_hourly_stats, sliding_hour_stats, stream_merge, unit_vectors, uniform_draws,
)}
QUERIES |= {"z_transform": _transformed("z"), "linear_transform": _transformed("linear"), "log_transform": _transformed("log")}

_U = "('0x' || substr(md5({} || '|{}'), 1, 13))::bigint / 4503599627370496.0"
SQL: dict[str, str] = {
    "most_popular_items": f"with {PREFS} select item_id, count(distinct user_id)::double as value from prefs group by 1 order by 2 desc, 1 limit 10",
    "pref_merge": _merge_sql(1.0, 0.0),
    "pref_merge_decay": _merge_sql(0.5, 5.0),
    "pref_merge_in_order": """with l as (select o_custkey user_id, l_partkey item_id, l_quantity v, l_returnflag = 'R' del, l_orderkey * 10 + l_linenumber seq from lineitem join orders on l_orderkey = o_orderkey),
        c as (select user_id, item_id, coalesce(max(case when del then seq end), -1) cut from l group by 1, 2)
        select user_id, item_id, round(sum(v), 4) as value from l join c using (user_id, item_id) where not del and seq > cut group by 1, 2 having abs(sum(v)) > 0""",
    "known_items": f"with {PREFS} select user_id, string_agg(item_id::varchar, ',' order by item_id) items from prefs group by 1",
    "item_vectors": f"with {PREFS} select item_id, string_agg(user_id || ':' || value::bigint, ',' order by user_id) entries from prefs group by 1",
    "id_mapping": """with n as (select 'u' || c_custkey as name from customer), h as (select name, md5(unhex(regexp_replace(hex(name), '(..)', '\\100', 'g'))) m from n),
        b as (select name, ('0x' || substr(m, 15, 2) || substr(m, 13, 2) || substr(m, 11, 2) || substr(m, 9, 2) || substr(m, 7, 2) || substr(m, 5, 2) || substr(m, 3, 2) || substr(m, 1, 2))::ubigint::hugeint u from h)
        select (case when u >= 9223372036854775808 then u - 18446744073709551616 else u end)::bigint id, name from b""",
    "topk_per_user": f"with {PREFS} select user_id, item_id, value, rank from (select *, row_number() over (partition by user_id order by value desc, item_id)::int as rank from prefs) where rank <= 3",
    "common_known_items": f"with {PREFS}, o as (select * from prefs where user_id in (34, 58)) select item_id from o group by 1 having count(*) = (select count(distinct user_id) from o)",
    "prune_stale": f"""with lines as (select o_custkey user_id, l_partkey item_id, l_quantity v, o_orderdate < timestamp '{SPLIT}' old from lineitem join orders on l_orderkey = o_orderkey),
        act as (select user_id from lines where not old and v > 45 union select user_id from (select user_id, item_id from lines where old group by 1, 2 having sum(v) > 90))
        select c_custkey user_id from customer where c_custkey in (select user_id from act)""",
    "gram_matrix": "with e as (select vec_id, unnest(embedding)::double x, unnest(range(len(embedding)))::int i from embeddings) select a.i, b.i j, round(sum(a.x * b.x), 4) v from e a join e b using (vec_id) group by 1, 2",
    "item_similarity_topk": f"""with n as (select vec_id, list_transform(embedding, lambda x: x::double / sqrt({_dot('embedding', 'embedding')})) v from embeddings),
        s as (select a.vec_id from_id, b.vec_id item_id, round({_dot('a.v', 'b.v')}, 10) s from n a join n b on a.vec_id <> b.vec_id)
        select from_id, item_id, round(s, 6) as value from (select *, row_number() over (partition by from_id order by s desc, item_id) r from s) where r <= 5""",
    "similarity_to_item": f"with q as (select unnest([0, 1, 2, 1000000000])::bigint item_id) select item_id, round({_cos('e.embedding', 't.embedding')}, 6) as value from q left join embeddings e on e.vec_id = item_id, (select embedding from embeddings where vec_id = 3) t",
    "most_similar_items": f"""with s as (select e.vec_id item_id, avg({_cos('e.embedding', 't.embedding')}) s from embeddings e, (select embedding from embeddings where vec_id in (1, 2)) t where e.vec_id not in (1, 2) group by 1)
        select item_id, round(s, 6) as value from s order by s desc, item_id limit 10""",
    "recommended_because": f"""with {PREFS}, s as (select user_id, item_id, {_cos('e.embedding', 't.embedding')} s from prefs join embeddings e on e.vec_id = item_id, (select embedding from embeddings where vec_id = 5) t where item_id <> 5)
        select user_id, item_id, round(s, 6) as value from (select *, row_number() over (partition by user_id order by s desc, item_id) r from s) where r <= 3""",
    "recommend_all": f"""with {PREFS}, {USERS}, s as (select user_id, vec_id item_id, round({_dot('x', 'embedding')}, 10) s from users, embeddings),
        k as (select s.* from s anti join prefs using (user_id, item_id))
        select user_id, item_id, round(s, 6) as value from (select *, row_number() over (partition by user_id order by s desc, item_id) r from k) where r <= 5""",
    "recommend_to_many": f"""with {PREFS}, {USERS}, o as (select * from prefs where user_id in (select user_id from users) and user_id in (1, 2, 3)),
        k as (select item_id from o group by 1 having count(*) = (select count(distinct user_id) from o)),
        s as (select vec_id item_id, avg({_dot('x', 'embedding')}) s from users, embeddings where user_id in (1, 2, 3) and vec_id not in (select item_id from k) group by 1)
        select item_id, round(s, 6) as value from s order by s desc, item_id limit 10""",
    "rescored_recommend": f"""with {PREFS}, {USERS}, s as (select vec_id item_id, {_dot('x', 'embedding')} * case when vec_id % 2 = 0 then 2 else 1 end s from users, embeddings where user_id = 1 and vec_id % 5 <> 0 and vec_id not in (select item_id from prefs where user_id = 1))
        select item_id, round(s, 6) as value from s order by s desc, item_id limit 10""",
    "estimate_preferences": f"with {PREFS}, {USERS} select p.user_id, p.item_id, round(coalesce({_dot('x', 'embedding')}, 0), 6) as value from prefs p left join users u using (user_id) left join embeddings e on e.vec_id = p.item_id",
    "fold_in_weight": """with t as (select event_id, (event_id % 11 - 5)::double v, (event_id % 7) / 4.0::double - 0.5 e from events)
        select event_id, round(case when v > 0 and e < 1 then (1 - 1 / (1 + v)) * (1 - greatest(0, e)) when v < 0 and e > 0 then (1 - 1 / (1 - v)) * -least(1, e) else 0 end, 8) w from t""",
    "column_summary": " union all ".join(f"select '{c}' as \"column\", count({c}) n, count(*) - count({c}) missing, round(min({c}), 4) x_min, round(max({c}), 4) x_max, round(avg({c}), 4) x_mean, round(stddev_pop({c}), 4) x_stddev from lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
    "category_histogram": " union all ".join(f"select '{c}' as \"column\", {c} as \"level\", count(*) n, false trimmed from lineitem where {c} is not null group by {c}" for c in ("l_returnflag", "l_linestatus")),
    "z_transform": "select p_partkey, round((p_retailprice - (select avg(p_retailprice) from part)) / (select stddev_pop(p_retailprice) from part), 6) v from part",
    "linear_transform": "select p_partkey, round((p_retailprice - (select min(p_retailprice) from part)) / (select max(p_retailprice) - min(p_retailprice) from part), 6) v from part",
    "log_transform": "select p_partkey, round(ln(p_retailprice), 6) v from part",
    "one_hot": "with l as (select list(distinct c_mktsegment order by c_mktsegment) ls from customer) select c_custkey, round(c_acctbal * 100)::bigint || ',' || list_aggregate(list_transform(ls, lambda x: case when x = c_mktsegment then '100' else '0' end), 'string_agg', ',') vec from customer, l",
    "assign_nearest": f"with {ASSIGN} select vec_id, cid center_id, round(sq, 6) sq from asg",
    "lloyd_step": f"with {ASSIGN}, u as (select cid, unnest(v) x, unnest(range({DIM}))::int i from asg) select cid center_id, count(*) n, i, round(avg(x), 6) x from u group by cid, i",
    "cluster_cost": f"with {ASSIGN} select count(*) n, round(sum(sq), 3) cost from asg",
    "contingency_vi_vd": f"""with {ASSIGN}, t as (select cid a, label b, count(*)::double c from asg group by 1, 2), ra as (select a, sum(c) c, max(c) m from t group by 1), rb as (select b, sum(c) c, max(c) m from t group by 1), n as (select sum(c) n from t),
        h as (select (select sum(-c / n * ln(c / n)) from ra, n) + (select sum(-c / n * ln(c / n)) from rb, n) ent, (select sum(t.c / n * ln(t.c * n / (ra.c * rb.c))) from t join ra using (a) join rb using (b), n) mi)
        select round((2 * n - (select sum(m) from ra) - (select sum(m) from rb)) / (2 * n - (select max(c) from ra) - (select max(c) from rb)), 6) vd, round(1 - 2 * mi / ent, 6) vi from n, h""",
    "cluster_covariance": f"with {ASSIGN}, u as (select vec_id, cid, unnest(v) x, unnest(range({DIM}))::int i from asg) select a.cid center_id, a.i, b.i j, round(covar_pop(a.x, b.x), 5) + 0.0::double cov from u a join u b on a.vec_id = b.vec_id and a.i <= b.i group by 1, 2, 3",
    "kfold_assign": f"select c_custkey, least(floor(({_U.format('c_custkey', 1729)}) * 5)::int, 4) as fold from customer",
    "weighted_sample": f"""with t as (select p_partkey, p_size, p_brand, ln(greatest({_U.format('p_partkey', 1729)}, 1e-300)) / p_size k from part where p_size > 0)
        select p_partkey, p_size, p_brand from (select *, row_number() over (partition by p_brand order by k desc, p_partkey) r from t) where r <= 2""",
    "tree_fold_assign": "select c_custkey, tree from customer, (select unnest(range(5))::int tree) where (c_custkey % 5 - tree + 5) % 5 < 3",
    "als_normal_equations": f"""with {PREFS}, t as (select user_id, 0.1::double * abs(value) c, list_sum(list_transform(embedding, lambda x: x::double)) total, unnest(embedding)::double f, unnest(range({DIM}))::int i from prefs join embeddings on vec_id = item_id)
        select user_id, count(*) n, i, round(sum((1 + c) * f), 3) + 0.0::double b, round(sum(c * f * total), 3) + 0.0::double w from t group by 1, 3""",
    "als_convergence": f"with {PREFS} select round(sum(abs(value - value * 0.9::double) * value) / sum(value), 6) as change from prefs where value > 0",
    "lsh_signature": _signature_sql(),
    "lsh_candidates": f"with s as ({_signature_sql()}) select a.item_id asked, s.item_id from s a, s where a.item_id % 20 = 0 and bit_count(xor(a.signature, s.signature)) <= {lsh.max_distance(16, 0.1)}",
    "class_entropy": "with c as (select l_shipdate, l_returnflag, count(*)::double c from lineitem group by 1, 2) select strftime(l_shipdate, '%Y-%m-%d') as day, round(ln(sum(c)) - sum(case when c > 1 then c * ln(c) else 0 end) / sum(c), 6) as entropy from c group by l_shipdate",
    "split_gain_categorical": """with p as (select l_quantity, sum((l_returnflag = 'A')::int)::double a, sum((l_returnflag = 'N')::int)::double n, sum((l_returnflag = 'R')::int)::double r from lineitem group by 1),
        c as (select l_quantity, sum(a) over w la, sum(n) over w lm, sum(r) over w lr, sum(a) over () ta, sum(n) over () tm, sum(r) over () tr from p window w as (order by l_quantity rows between unbounded preceding and 1 preceding)),
        u as (select l_quantity, [la, lm, lr] l, [ta - la, tm - lm, tr - lr] g, [ta, tm, tr] t from c where la is not null),
        h as (select l_quantity, list_sum(l) nl, list_sum(g) ng, list_sum(t) nt, ln(list_sum(l)) - list_sum(list_transform(l, lambda x: case when x > 1 then x * ln(x) else 0 end)) / list_sum(l) hl,
          ln(list_sum(g)) - list_sum(list_transform(g, lambda x: case when x > 1 then x * ln(x) else 0 end)) / list_sum(g) hg, ln(list_sum(t)) - list_sum(list_transform(t, lambda x: case when x > 1 then x * ln(x) else 0 end)) / list_sum(t) ht from u)
        select l_quantity, round(ht - (nl * hl + ng * hg) / nt, 8) gain from h""",
    "split_gain_numeric": """with p as (select l_quantity, count(*)::double n, sum(round(l_tax * 100)) s, sum(round(l_tax * 100) * round(l_tax * 100)) q from lineitem group by 1),
        c as (select l_quantity, sum(n) over w a, sum(s) over w b, sum(q) over w c, sum(n) over () n, sum(s) over () s, sum(q) over () q from p window w as (order by l_quantity rows between unbounded preceding and 1 preceding))
        select l_quantity, round(0.5 * (ln((q - s * s / n) / (n - 1)) - (a * ln((c - b * b / a) / (a - 1)) + (n - a) * ln((q - c - (s - b) * (s - b) / (n - a)) / (n - a - 1))) / n), 8) gain from c where a > 1 and n - a > 1""",
    "weighted_vote": "with v as (select l_orderkey, l_returnflag c, sum(l_quantity) s from lineitem group by 1, 2) select l_orderkey, arg_min(c, (-s, c)) winner from v group by 1",
    "rmse_accuracy": "select count(*) n, round(avg(((case when l_quantity > 25 then 'N' else 'A' end) = l_returnflag)::int), 8) accuracy, round(sqrt(avg((25 - l_quantity) * (25 - l_quantity))), 6) rmse, round(avg(abs(l_quantity)), 6) mean_abs from lineitem",
    "decision_predicates": "select c_custkey, coalesce(case when c_acctbal > 0 then c_acctbal end >= 4500, true) numeric_side, coalesce(c_mktsegment in ('BUILDING', 'MACHINERY'), false) level_side from customer",
    "csv_round_trip": """select c_custkey, '"' || replace(c_name || ',"x" ', '"', '""') || '",,' || c_custkey as line, c_name || ',"x" ' a, '' b, c_custkey::varchar c from customer""",
    "events_hourly_stats": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') window_start, event_type, count(value) n, round(avg(value), 4) mean, round(min(value), 4) low, round(max(value), 4) high from events group by 1, 2",
    "sliding_hour_stats": "select event_id, count(*) over w n, round(min(value) over w, 4) low, round(max(value) over w, 4) high from events window w as (partition by event_type order by epoch_us(ts) range between 3600000000 preceding and current row)",
    "stream_merge": f"""with l as (select o_custkey user_id, l_partkey item_id, l_quantity v, l_returnflag = 'R' del, case when o_orderdate < timestamp '{STREAM_CUTS[0]}' then 0 when o_orderdate < timestamp '{STREAM_CUTS[1]}' then 1 else 2 end k from lineitem join orders on l_orderkey = o_orderkey),
        a as (select user_id, item_id, coalesce(sum(v) filter (k = 0 and not del), 0) a0, coalesce(sum(v) filter (k = 1 and not del), 0) a1, coalesce(sum(v) filter (k = 2 and not del), 0) a2, coalesce(bool_or(del) filter (k = 1), false) d1, coalesce(bool_or(del) filter (k = 2), false) d2 from l group by 1, 2),
        m as (select user_id, item_id, case when d2 then 0 else case when d1 then 0 else a0 end + a1 end + a2 as value from a)
        select user_id, item_id, round(value, 4) as value from m where abs(value) > 0""",
    "unit_vectors": "select p_partkey item_id, 1.0::double as length from part",
    "uniform_draws": f"select c_custkey, {_U.format('c_custkey', 7)} u from customer",
}
