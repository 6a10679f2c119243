"""The subpackage's queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, lm_scoring, minhash_dedup, packing, quality_classifier, quality_rules, secret_scan, substring_dedup, token_store
from .storage import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.host_quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *quality_rules.METRICS[:5], "base_failed", "kept", "host_docs", "host_rate")


def fold(of: int) -> Column:
    """crc32 of doc_id as text, modulo ``of``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranking = quality_classifier.train(docs, table(spark, sf_dir, "labels"), fold(5) != 0)
    return quality_classifier.score(docs, ranking).withColumn("held_out", fold(5) == 0)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, fold(4) != 2)
    return language_id.predict(docs, model).withColumn("held_out", fold(4) == 2)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.pseudo_likelihood_scores(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).drop("ids")


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), minhash_dedup.DedupSettings(shingle=4))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents")).drop("base")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_language_id": op3_language_id,
        "op4_decontamination": op4_decontamination,
        "op5_lm_scoring": op5_lm_scoring,
        "op6_packing": op6_packing,
        "op7_minhash_dedup": op7_minhash_dedup,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_secret_scan": op9_secret_scan,
        "op10_token_output": op10_token_output,
    }


_WORDS = r"'[^\x20\x09-\x0D]+'"

#: The rules of op1 and their hosts' beta priors; fails_ and rates in the order of the rules.
_OP1 = f"""
with d as (select doc_id, coalesce(text, '') t, case when source is null then 'n' else 'h' || source end host from documents),
m as (select doc_id, host, t, regexp_extract_all(t, {_WORDS}) w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_WORDS})) ls from d),
g as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g from (select doc_id, w, unnest(range(1, len(w) - 1)) i from m)),
h as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) c from g) where c > 1),
r as (select doc_id, count(distinct i + k) n from h, (select unnest(range(3)) k) group by 1),
f as (select doc_id, host, len(w)::bigint n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) n_symbols, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(n, 0)::bigint n_repeat_words,
    len(ls) n_lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) n_upper from m left join r using (doc_id)),
q as (select *, n_words < 50 a, 100 * n_repeat_words > 50 * n_words b, 100 * n_symbols > 10 * n_words c, 100 * n_dup_lines > 60 * n_lines e, 100 * n_upper > 50 * word_chars u from f),
hosts as (select host, count(*) n, unnest(range(5)) k, [sum(a::int), sum(b::int), sum(c::int), sum(e::int), sum(u::int)] fs from q group by host),
x as (select host, n, k, fs[k + 1]::double f, fs[k + 1] / n p from hosts),
v as (select k, avg(p) m, var_pop(p) v from x group by k),
z as (select k, m, case when v < 1e-12 then 1000.0 else least(greatest(m * (1 - m) / v - 1, 1.0), 1000.0) end wt from v),
hr as (select host, any_value(n) host_docs, max((f + m * wt) / (n + wt)) rate from x join z using (k) group by host)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, a or b as base_failed, not (a or b or c or e or u or rate > 0.5) as kept, host_docs, round(rate, 6) host_rate
from q join hr using (host)"""

_OP7 = f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 3], ' ') g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) i from w where len(w) > 0)),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * c >= 80 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r(doc_id, o) as (select doc_id, doc_id from documents union select r.doc_id, e.b from r join e on r.o = e.a)
select doc_id, coalesce(n, 0) n_shingles, component_id, component_id = doc_id as kept
from (select doc_id, min(o) component_id from r group by 1) left join n using (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """The others train models, tokenize or hash; tests hold them to slow versions."""
    return {"op1_quality_rules": _OP1, "op7_minhash_dedup": _OP7}
