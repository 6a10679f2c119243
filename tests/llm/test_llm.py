"""Operators against slow versions and on odd input: nulls, empties, repeats."""

import hashlib
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quarry.llm import decontaminate, language_id, lm_scoring, minhash_dedup, packing, quality_classifier, quality_rules, secret_scan, substring_dedup, token_store, tokenizing
from quarry.llm.queries import fold
from quarry.llm.tokenizing import vocabulary

from . import brute

DIR = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "One two\x0bthree  four\n\nfive"), (6, "word " * 3000), (7, "é ñ\x1f|#\n#x\n#x\n"), (8, "One two\x0bthree  four\n\nfive")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def slow_measure(text):
    words = brute.WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if brute.WORD.search(x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_metrics_are_exact(rows):
    for _, t in [*rows, *ODD]:
        assert quality_rules.measure(t)[:5] == slow_measure(t)


def test_host_verdicts_shrink(spark):
    junk, fine = "a b c " * 60, " ".join(f"w{i}" for i in range(80))
    data = [(i, fine, "good") for i in range(20)] + [(100 + i, junk, "bad") for i in range(20)] + [(200, fine, "bad"), (201, fine, None), (202, None, None)]
    got = {r.doc_id: r for r in quality_rules.host_quality(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert got[0].kept and not got[100].kept and not got[200].kept and got[201].kept and got[202].base_failed and not got[200].base_failed


def test_quality_ranking_generalizes(spark, docs):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    ranking = quality_classifier.train(docs, labels, fold(5) != 0)
    out = quality_classifier.score(docs, ranking).join(labels, "doc_id").where(fold(5) == 0)
    assert out.where("predicted = quality").count() >= 0.9 * out.count()
    kept = quality_classifier.score(docs, ranking, keep=True)
    assert kept.columns == docs.columns and kept.count() == quality_classifier.score(docs, ranking).where("predicted = 1").count()
    assert quality_classifier.score(docs, None).select("score").distinct().first()[0] == 0.5


def test_quality_training_uses_every_labelled_row(spark):
    """The threshold is the exact quantile of all rows, and no row is left out of the sums."""
    n = 12_000  # more than any sample of before
    rng = np.random.default_rng(2)
    data = [(i, " ".join("Ab"[j % 2] * (j % 23 + 1) + f"{j}," * (j % 5) for j in rng.integers(0, 10**6, 20 + i % 31)) + ("!" * (i % 7) if i % 4 else " ##"), int(i % 4 > 0)) for i in range(n)]
    df = spark.createDataFrame(data, "doc_id long, text string, quality int")
    ranking = quality_classifier.train(df, df.select("doc_id", "quality"), F.lit(True))
    own = sorted({(y, *map(float, quality_classifier.features(t))) for _, t, y in data})
    scores = np.sort(np.array([r[1:] for r in own]) @ ranking.weights)
    k = sum(r[0] == 0 for r in own)
    assert len(own) > 8000 and abs((scores[k - 1] + scores[k]) / 2 - ranking.cut) < 1e-9
    s = quality_classifier.QualitySettings()
    rows = spark.createDataFrame([(r[0], list(r[1:])) for r in own], "label int, x array<double>")
    dealt = quality_classifier._bucketed(rows, {0: k, 1: len(own) - k}, s)
    assert dealt.select("label", "x").distinct().count() == len(own)
    assert dealt.groupBy("bucket").agg(F.countDistinct("label").alias("n")).where("n < 2").isEmpty()


def test_language_model_is_kneser_ney():
    s = language_id.LanguageSettings()
    counts = {l: Counter(x[i : i + 4] for i in range(len(x) - 3)) for l, x in (("a", " the cat the hat "), ("b", " der hut der kater "))}
    m = language_id.estimate(counts, s)
    for l in "ab":
        c = {4: counts[l]}
        for k in (3, 2, 1):
            c[k] = Counter(g[1:] for g in c[k + 1])
        ones = {k: sum(v == 1 for v in c[k].values()) for k in c}
        twos = {k: sum(v == 2 for v in c[k].values()) for k in c}
        cut = {k: float(np.clip(ones[k] / max(1, ones[k] + 2 * twos[k]), 0.1, 0.95)) for k in c}

        def p(g, c=c, cut=cut):
            lower = p(g[1:]) if len(g) > 1 else 1 / s.alphabet
            same = [v for h, v in c[len(g)].items() if h[:-1] == g[:-1]]
            return lower if not same else (max(c[len(g)][g] - cut[len(g)], 0) + cut[len(g)] * len(same) * lower) / sum(same)

        line = language_id.letters("The kat zzz")
        want = -np.mean([np.log(p(line[max(0, i - 3) : i + 1])) for i in range(1, len(line))])
        assert m.entropies("The kat zzz")[0]["ab".index(l)] == pytest.approx(want, rel=1e-5)
    assert m.languages[m.entropies("the hat")[0].argmin()] == "a"


def test_languages_of_held_out_documents(docs):
    out = language_id.predict(docs, language_id.train(docs, fold(4) != 2)).join(docs.select("doc_id", "lang"), "doc_id").where(fold(4) == 2)
    assert out.where("lang_pred = lang").count() >= 0.9 * out.count()


def test_letters_are_what_unicode_says(spark):
    assert language_id.letters("½ ² Ⅷ 12_") == "" and language_id.letters("Aé½b ⅷ 日本") == " aé b 日本 "
    data = [(i, "der hund und die katze " * 3, "de") for i in range(30)] + [(100 + i, "the dog and the cat " * 3, f"x{i}") for i in range(230)] + [(500, "½ ²", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language_id.train(docs, F.lit(True))
    assert len(model.languages) == 231
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs, model).collect()}
    assert got[0] == "de" and got[500] == "und" and got[100].startswith("x")


def test_leaks_are_all_found_and_nothing_else(spark, docs, rows):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    norm = lambda t: " " + " ".join(brute.WORD.findall(brute.ascii_lower(t or ""))) + " "
    want = {(d, i) for d, t in rows for i, u in items if norm(u) in norm(t)}
    assert want and want <= got
    for d, i in got - want:
        a, b = (brute.shingle_set(dict(x)[k], 5) for x, k in ((rows, d), (items, i)))
        assert len(a & b) >= 0.7 * len(b)


def test_signs_at_words_do_not_hide_leaks(spark):
    around = " ".join(f"z{i}" for i in range(70))
    item = "What did the seven sailors carry over the frozen river in spring? Bread and salt for été."
    texts = [item.replace("été.", "été.&&&"), item.replace("salt for été.", "“salt for été”"), item.replace("seven", "(seven)").upper().replace("ÉTÉ.", "ÉTÉ.!!"), item.replace("Bread and salt for été.", "They came home."), item.replace("salt for", "salt &&& for")]
    docs = spark.createDataFrame([(i, f"{around} {t} {around}") for i, t in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, "Why is the sky over the northern harbour so often grey? Rain.")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()} == {(i, 1) for i in (0, 1, 2, 4)}
    assert [r.doc_id for r in decontaminate.clean(docs, items).collect()] == [3]


def test_wand_finds_what_a_full_scan_finds():
    rng = np.random.default_rng(4)
    items = [(i, " ".join(f"w{j}" for j in rng.zipf(1.3, 30) % 200)) for i in range(90)]
    index = decontaminate.build(items)[0]
    for _ in range(50):
        terms = np.unique(rng.zipf(1.3, 60) % len(index.vocabulary))
        full = Counter()
        for block in range(index.n_blocks):
            for e in index.entries(terms, block):
                for i, w in index.postings(e):
                    full[i] += w
        want = {i for i, w in full.items() if w >= index.settings.threshold}
        assert {i for i, _ in index.search(terms, np.arange(index.n_blocks))} == want


def test_leaks_equal_a_scan_of_all_passages_and_items(spark, docs, rows):
    """BM25 of every passage with every item from the formula, and overlaps from sets."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    for s in (decontaminate.LeakSettings(), decontaminate.LeakSettings(cells=16)):
        got = {(r.doc_id, r.item_id): (r.passage_word, round(r.score, 6)) for r in decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string"), s).collect()}
        assert got == brute.leaks(rows, items)


def test_pseudo_likelihood_sums_every_word():
    s = lm_scoring.LmSettings(frequent=24, hashed=8, branches=4)
    net, text = lm_scoring.Network(s), np.array([1, 5, 30, 2, 2, 9])
    padded = [s.ids] * s.side + text.tolist() + [s.ids] * s.side
    want = 0.0
    for i, w in enumerate(text):
        around = [padded[i + s.side + d] for d in range(-s.side, s.side + 1) if d]
        h = np.tanh(net.start + sum(net.embed[a] * net.gate[d] for d, a in enumerate(around)))
        for k in range(s.depth):
            z = np.append(h, 1) @ net.out[k][w // 4 ** (s.depth - k)]
            want += z[w // 4 ** (s.depth - 1 - k) % 4] - np.log(np.exp(z).sum())
    assert s.depth == 3 and lm_scoring.pseudo_likelihoods(net, [np.zeros(0, int), text])[1] == pytest.approx(want, rel=1e-4)
    around, words = net.contexts([text])
    g = net.gradient(around, words)
    for at in (40, 4 * s.width, (s.ids + 1) * s.width + 3, len(net.flat) - 40, len(net.flat) - 3):
        up = lm_scoring.Network(s, net.flat.astype(np.float64))
        loss = lambda: -up.log_probabilities(around, words).mean()
        up.flat[at] += 1e-4
        high = loss()
        up.flat[at] -= 2e-4
        assert g[at] == pytest.approx((high - loss()) / 2e-4, abs=1e-4)


def test_gradient_sums_places_without_a_copy_for_each_word():
    """Sums of each id make the embeddings' and the gates' gradients; no window of vectors is held."""
    s, rng = lm_scoring.LmSettings(), np.random.default_rng(5)
    net = lm_scoring.Network(s)
    around, words = net.contexts([rng.integers(0, s.ids, 1 << 14)])
    tracemalloc.start()
    g = lm_scoring.Network(s, net.gradient(around, words).copy())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 700 * len(words)  # 849 bytes a word with them
    order, dh = np.argsort(words, kind="stable"), np.zeros((len(words), s.width))
    around, words = around[order], words[order]
    full = net._hidden(around)
    h = full[:, :-1]
    for k in range(s.depth):
        p, digit = net._level(full, words, k)[:2]
        p = np.exp(p.astype(np.float64))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(words)), digit] -= 1
        node = words // s.branches ** (s.depth - k)
        dh += np.einsum("nb,nwb->nw", p, net.out[k][node, :-1])
    dh *= 1 - h**2
    want, gates = np.zeros(net.embed.shape), np.zeros(net.gate.shape)
    for d in range(2 * s.side):
        np.add.at(want, around[:, d], dh * net.gate[d])
        gates[d] = (dh * net.embed[around[:, d]]).sum(0)
    assert np.allclose(g.embed, want / len(words), atol=1e-7) and np.allclose(g.gate, gates / len(words), atol=1e-6)


def test_training_lowers_loss_whatever_the_partitions(spark, docs):
    s, vocabulary, words = lm_scoring.corpus_vocabulary(docs, lm_scoring.LmSettings(batch=1024))
    nets = [lm_scoring.train(lm_scoring.coded(docs.repartition(n), vocabulary, s), words, s) for n in (1, 7)]
    assert np.allclose(nets[0].flat, nets[1].flat, atol=1e-5)
    texts = [lm_scoring.word_ids(r.text, vocabulary, s) for r in docs.collect()]
    before, after = (lm_scoring.pseudo_likelihoods(n, texts).sum() / words for n in (lm_scoring.Network(s), nets[0]))
    counts = np.bincount(np.concatenate(texts), minlength=s.ids)
    by_frequency = (counts[counts > 0] * np.log(counts[counts > 0] / words)).sum() / words
    assert after > before + 0.9 and after > by_frequency + 0.1


def test_every_document_trains_the_network(spark):
    s, none = lm_scoring.LmSettings(batch=100), (np.zeros(0, np.uint64), np.zeros(0, np.int32))
    text = "the cat sat on the mat " * 200
    ids = [lm_scoring.word_ids(text, none, s)]
    for i in range(4):
        table = lm_scoring.coded(spark.createDataFrame([(i, text)], "doc_id long, text string"), none, s)
        net = lm_scoring.train(table, 1200, s)
        assert lm_scoring.pseudo_likelihoods(net, ids)[0] > lm_scoring.pseudo_likelihoods(lm_scoring.Network(s), ids)[0] + 1
    s = lm_scoring.fitted(lm_scoring.LmSettings(), 100_000_000, 5_000_000)
    assert s.frequent == 10_000 and s.hashed == 2500 and s.depth == 3
    assert lm_scoring.fitted(lm_scoring.LmSettings(), 1000, 300) == lm_scoring.LmSettings()


def slow_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def test_words_before_signs_are_not_encoded_again():
    """A known word needs no other look at the model when a sign follows it."""
    encoder = tokenizing.Encoder(tokenizing.vocabulary())
    encoder.encode("some Words hereabouts fa\u00e7ade")

    def no_more(*_):
        raise AssertionError("encoded again")

    encoder.known.word = encoder.known.ids_of = no_more
    text = "some Words, hereabouts. fa\u00e7ade!"
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.model.encode(text, add_special_tokens=False).ids


def test_pieces_are_those_of_whole_texts_when_few_are_kept(monkeypatch):
    """Ids are the library's whatever letters and signs meet, and whatever was kept."""
    monkeypatch.setattr(tokenizing, "KEEP", 60)
    monkeypatch.setattr(tokenizing, "KEEP_FIRST", 20)
    encoder, rng = tokenizing.Encoder(tokenizing.vocabulary()), np.random.default_rng(64)
    parts = ["word", "Stra\u00dfe", "\u01c5", "\u4e2d\u6587", "\U0002ebf0", "\u1c89", "\u0627\u0644", "e\u0301", "a1", "x" * 300, "don't", "\u00aa", "\u00b2", "\ua7dc", "I'll", "'s", "_"]
    texts = [" ".join(p + s for s in ("", ",", ".", ";", ":", "!", "?", ",,", "?!")) for p in parts]
    for _ in range(200):
        some = rng.integers(0, len(parts), 12)
        texts.append("".join(parts[i] + s for i, s in zip(some, rng.choice([" ", ", ", "\n", ".\n", "! ", "?", "  "], 12))))
    texts += [f"w{i} w{i}, v{i // 2}." for i in range(100)]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.model.encode(text, add_special_tokens=False).ids, text
        assert len(encoder.known) <= 60 + 80


def test_packed_ids_are_kept_in_few_bytes(spark):
    """Two bytes an id where that is enough, four elsewhere, and the same ids from either."""
    df = spark.createDataFrame([(i, "one two three, " * i) for i in range(9)], "doc_id long, text string")
    rows = packing.encode_stream(df, tokenizing.vocabulary(), packing.PackSettings(), "text").collect()
    ends = {r.doc_id: tokenizing.encode_texts(tokenizing.vocabulary(), ["one two three, " * r.doc_id])[0] for r in rows}
    assert all(np.frombuffer(r.ids, "<u2").tolist() == [*np.frombuffer(ends[r.doc_id], "<u4").tolist(), 0] for r in rows)
    own = [np.arange(3, dtype="<u2"), np.array([70000, 1], "<u4"), np.zeros(0, "<u2"), np.array([65535], "<u2")]
    cells, width = pa.array([b"left out", *(x.tobytes() for x in own)], pa.binary())[1:], np.array([x.itemsize for x in own])
    ids, counts = packing._flat(cells, width)
    assert ids.tolist() == [0, 1, 2, 70000, 1, 65535] and counts.tolist() == [3, 2, 0, 1]
    assert packing._binary(ids, counts).to_pylist() == [x.astype("<u4").tobytes() for x in own]


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_packing_is_gapless_and_exact(request, which):
    df = request.getfixturevalue(which)
    texts = {}
    for r in df.collect():
        texts.setdefault(r.doc_id, []).append(slow_ids(r.text) + [0])
    out = packing.pack(df).orderBy("sequence_id", "offset").collect()
    place = 0
    for r in out:
        assert r.sequence_id * 1024 + r.offset == place
        place += r.length
        own = [x for x in texts[r.doc_id] if len(x) == r.doc_tokens and zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32]
        assert own
    assert place == sum(len(x) for v in texts.values() for x in v)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_token_files_round_trip(request, which):
    df = request.getfixturevalue(which)
    got = sorted(map(tuple, token_store.store_and_digest(df).collect()), key=lambda r: r[1])
    start, want = 0, []
    for r in df.select("doc_id", "text", F.xxhash64("text").alias("h")).orderBy("doc_id", "h").collect():
        ids = slow_ids(r.text) + [2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_token_files_have_dictionaries_row_groups_and_page_indexes(spark, docs, nothing, tmp_path):
    at = f"file://{tmp_path}/tokens"
    token_store.write_tokens(docs, at, settings=token_store.StoreSettings(row_group_bytes=1 << 14, page_bytes=1 << 12))
    files = [pq.ParquetFile(f) for f in sorted(tmp_path.glob("tokens/*.parquet"))]
    assert sum(f.metadata.num_row_groups for f in files) > len(files) > 1
    chunk = {f.metadata.row_group(0).column(i).path_in_schema.split(".")[0]: f.metadata.row_group(0).column(i) for f in files for i in range(5)}
    assert "RLE_DICTIONARY" in chunk["ids"].encodings and any("DELTA" in e or "RLE_DICTIONARY" in e for e in chunk["local_start"].encodings)
    assert all(c.has_offset_index and c.has_column_index for c in chunk.values())
    stored = token_store.read_tokens(spark, at)
    want = [len(slow_ids(r.text)) + 1 for r in docs.orderBy("doc_id").collect()]
    some = stored.where("doc_id between 3 and 5").select("doc_id", "n_tokens")
    plan = some._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,n_tokens:bigint>" in plan and "GreaterThanOrEqual(doc_id,3)" in plan
    assert [r.n_tokens for r in stored.orderBy("doc_id").select("n_tokens").collect()] == want
    assert token_store.store_and_digest(nothing).count() == 0


@pytest.mark.parametrize("hot_list", [4096, 2])
def test_near_duplicates_equal_all_pairs(spark, rows, hot_list):
    base = " ".join(f"w{i}" for i in range(60))
    more = [(10_000 + i, " ".join(x if j != 7 * i else f"z{i}" for j, x in enumerate(base.split()))) for i in range(8)]
    data = [*rows, *more, *[(i + 20_000, t) for i, t in ODD if i != 4]]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), minhash_dedup.DedupSettings(shingle=4, hot_list=hot_list)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near_duplicate_components(data, 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize(("length", "edits"), [(60, 1), (100, 2)])
def test_a_large_group_of_near_copies_costs_its_size(spark, monkeypatch, length, edits):
    """No table grows with the pairs of a group, be they linked or just below the similarity."""
    rng = np.random.default_rng(5)
    base, n = [f"w{i}" for i in range(length)], 500
    data = []
    for i in range(n):
        words = list(base)
        for j in rng.choice(length, edits, replace=False):
            words[j] = f"z{i}x{j}"
        data.append((i, " ".join(words)))
    made, write = Counter(), minhash_dedup.materialize

    def counted(df, label, **options):
        out = write(df, label, **options)
        made[label] = max(made[label], out.count())
        return out

    monkeypatch.setattr(minhash_dedup, "materialize", counted)
    got = minhash_dedup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), minhash_dedup.DedupSettings(shingle=4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near_duplicate_components(data, 4)
    assert max(made.values()) <= 32 * n, made


def test_one_of_each_keeps_columns_and_one_repeat(odd):
    out = minhash_dedup.one_of_each(odd)
    assert out.columns == odd.columns and sorted(r.doc_id for r in out.collect()) == [1, 2, 3, 4, 5, 6, 7]


def test_one_of_each_judges_every_text_of_an_id(spark):
    rng = np.random.default_rng(12)
    word = lambda n=60: " ".join(f"v{i}" for i in rng.integers(0, 10**6, n))
    x, y, z = word(), word(), word()
    near = f"{z} end"
    data = [(1, x), (5, x), (5, y), (5, y), (9, near), (7, z), (7, near), (None, x), (None, x), (None, None), (8, None), (8, None), (8, "")]
    kept = minhash_dedup.one_of_each(spark.createDataFrame(data, "doc_id long, text string")).collect()
    got = Counter((r.doc_id, r.text) for r in kept)
    of_z = [k for k in got if k[1] in (z, near)]
    assert len(of_z) == 1 and of_z[0][0] == 7 and got.pop(of_z[0]) == 1
    assert got == {(1, x): 1, (5, y): 1, (None, x): 2, (None, None): 1, (8, None): 1, (8, ""): 1}


def test_repeated_passages(spark):
    rng = np.random.default_rng(8)
    word = lambda n: " ".join(f"v{i}" for i in rng.integers(0, 10**6, n))
    shared, line = word(60), word(20)
    data = [(1, f"{word(80)} {shared} {word(10)}"), (2, f"{shared} {word(90)}"), (3, f"{word(70)} {line} {word(70)}"), (4, f"{line} {word(100)}"), (5, word(100)), (6, f"{word(30)} {shared}")]
    data += [(7, data[4][1]), (8, None), (9, "short"), (9, "short")]
    out = substring_dedup.repeated_passages(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {r.doc_id for r in out} == {1, 2, 5, 6, 7}
    assert {(r.start, r.end) for r in out if r.doc_id == 1} == {(80, 140)}


def test_exact_passages_are_found_beside_near_copies(spark):
    """Every run of 50 words that two texts share is in spans that link them."""
    rng = np.random.default_rng(31)
    word = lambda n: [f"v{i}" for i in rng.integers(0, 10**6, n)]
    data = []
    for k in range(30):
        copy, at = word(300), 120
        first = list(copy)
        for j in rng.choice(60, 2 + k % 2, replace=False):
            first[at + int(j)] = "changed"
        data += [(10 * k, first), (10 * k + 1, copy), (10 * k + 2, [*word(40), *copy[at : at + 60], *word(40)])]
        x, y = word(60), word(60)
        data += [(10 * k + 3, [*x, *word(50)]), (10 * k + 4, [*x, *y]), (10 * k + 5, [*word(30), *y]), (10 * k + 6, [*word(20), *y[:55], *word(9)])]
    out = substring_dedup.repeated_passages(spark.createDataFrame([(d, " ".join(w)) for d, w in data], "doc_id long, text string"))
    spans = [r for r in out.collect() if r.kind == "passage"]
    runs = brute.repeats(data, 50)
    assert {(10 * k + 1, 10 * k + 2) for k in range(30)} <= {p for m in runs for p in zip(sorted(m), sorted(m)[1:])}
    for places in runs:
        covers = [(r.doc_id, r.other_id) for r in spans if r.doc_id in places and r.other_id in places and r.start <= places[r.doc_id] + 4 and places[r.doc_id] + 46 <= r.end and r.other_start <= places[r.other_id] + 4 and places[r.other_id] + 46 <= r.other_end]
        met = {min(places)}
        for _ in places:
            met |= {b for a, b in covers if a in met}
        assert met == set(places), (places, covers)


def test_near_passages_meet_beside_texts_with_fragments(spark):
    """Two edited copies of a passage are found whatever else holds parts of it."""
    rng = np.random.default_rng(77)
    word = lambda n: [f"v{i}" for i in rng.integers(0, 10**6, n)]
    data, n = [], 40
    for k in range(n):
        passage = word(230)
        other = list(passage)
        for j in range(40, 230, 46):
            other[j] = "changed"
        for i in range(k % 4):  # documents of lower and higher ids with pieces of 35 words
            pieces = [w for at in range(10 * i, 195, 50) for w in (*passage[at : at + 35], *word(20))]
            data.append((100 * k + 20 * i, pieces))
        data += [(100 * k + 11, [*word(40), *passage]), (100 * k + 31, [*other, *word(30)])]
    out = substring_dedup.repeated_passages(spark.createDataFrame([(d, " ".join(w)) for d, w in data], "doc_id long, text string"))
    met = {(r.doc_id, r.other_id) for r in out.collect()}
    assert sum((100 * k + 11, 100 * k + 31) in met for k in range(n)) == n
    assert all(a // 100 == b // 100 for a, b in met)


def test_a_group_parted_by_fragments_is_joined(spark):
    """Near copies are linked in each group as all pairs of it would be, with many fragments between them."""
    rng = np.random.default_rng(78)
    word = lambda n: [f"v{i}" for i in rng.integers(0, 10**6, n)]
    data, n = [], 15
    for k in range(n):
        passage = word(60)
        other = list(passage)
        other[30 if k % 2 else 29] = "changed"
        data += [(1000 * k, [*word(9), *passage, *word(9)]), (1000 * k + 999, [*word(5), *other, *word(9)])]
        for i in range(1, 41):
            at = int(rng.integers(0, 30))
            data.append((1000 * k + i, [*word(60), *passage[at : at + 31], *word(60)]))
    out = substring_dedup.repeated_passages(spark.createDataFrame([(d, " ".join(w)) for d, w in data], "doc_id long, text string"))
    met = {(r.doc_id, r.other_id) for r in out.collect()}
    assert all({a % 1000, b % 1000} == {0, 999} and a // 1000 == b // 1000 for a, b in met)
    assert sum((1000 * k, 1000 * k + 999) in met for k in range(n)) >= 13


def test_runs_of_one_word_meet_few_others(spark):
    """Texts that share a repeated word alone are not aligned; near copies with such a run are."""
    s, rng = substring_dedup.PassageSettings(), np.random.default_rng(79)
    word = lambda n: [f"v{i}" for i in rng.integers(0, 10**6, n)]
    passage = word(60)
    other = [*passage[:29], "changed", *passage[30:]]
    texts = [[*word(50), *["the"] * int(rng.integers(25, 40)), *word(50)] for _ in range(60)]
    texts += [[*word(50), *["the"] * 30, *p, *word(9)] for p in (passage, other)]
    looks = []
    for node, w in enumerate(texts):
        hashes = substring_dedup.word_hashes(" ".join(w))
        run = [i for i in range(len(w) - 4) if w[i : i + 5] == ["the"] * 5]
        looks.append(substring_dedup._looks(hashes, node, np.array(run) | 1 << substring_dedup._PLACE, s))
    met = np.concatenate(list(substring_dedup.met_by_looks(np.concatenate(looks), s)))
    pairs = set(zip(met["a"].tolist(), met["b"].tolist()))
    assert len(pairs) < 60 and len(met) < 5000  # 269 and 19,827 when all that agree beside the centre were compared
    assert (61, 60) in pairs
    out = substring_dedup.repeated_passages(spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(texts)], "doc_id long, text string"))
    assert {(r.doc_id, r.other_id) for r in out.collect()} == {(60, 61), (61, 60)}


def test_a_passage_whose_last_words_differ():
    """43 equal words of 47 are a similar passage: 39 of 47 shingles, and of 49 no more."""
    s = substring_dedup.PassageSettings()
    x, y = (np.arange(k, k + 100, dtype=np.uint64) for k in (1000, 2000))
    x[20:63] = y[30:73] = np.arange(43)
    assert [(b - a, b2 - a2) for a, b, a2, b2 in substring_dedup.passages(x, y, [(40, 50)], s)] == [(47, 47)]
    y[72] = 9  # 42, and 41 of them equal: 37 of 47
    x[62] = 8
    y[71] = 9
    assert substring_dedup.passages(x, y, [(40, 50)], s) == []


def test_two_texts_under_one_id_and_repeated_rows(spark):
    rng = np.random.default_rng(3)
    word = lambda n: " ".join(f"v{i}" for i in rng.integers(0, 10**6, n))
    x, y = word(60), word(70)
    data = [(1, x), (1, y), (1, y), (2, f"{x} {word(9)}"), (3, f"{word(9)} {y}"), (None, x), (4, None)]
    out = substring_dedup.repeated_passages(spark.createDataFrame(data, "doc_id long, text string")).where("kind = 'passage'")
    assert {(r.doc_id, r.other_id) for r in out.collect()} == {(1, 2), (2, 1), (1, 3), (3, 1)}


def test_windows_cover_every_passage():
    """The smallest token of any passage of the least length is a window's centre."""
    s, rng = substring_dedup.PassageSettings(), np.random.default_rng(6)
    words = rng.integers(0, 40, 300).astype(np.uint64)
    width = s.least - s.shingle + 1
    for values in substring_dedup._hash_values(substring_dedup.shingles(words, s.shingle), s):
        centres = {c: (l, r) for l, c, r in substring_dedup.compact_windows(values, width)}
        for at in range(len(values) - width + 1):
            c = at + int(values[at : at + width].argmin())
            assert centres[c][0] <= at and at + width - 1 <= centres[c][1]


def test_windows_of_many_texts_are_those_of_each():
    """Texts laid side by side have the windows that each has alone, also where tokens repeat."""
    s, rng = substring_dedup.PassageSettings(), np.random.default_rng(61)
    width = s.least - s.shingle + 1
    texts = [rng.integers(0, 2**32, n).astype(np.uint64) for n in (0, 3, s.least - 1, s.least, 47, 300, 90)]
    texts += [np.tile(texts[3], 4), np.full(70, 7, np.uint64), rng.integers(0, 2, 200).astype(np.uint64)]
    number, key, centre, sketch = substring_dedup.windows_of(texts, s)
    got = sorted(zip(number.tolist(), (key & np.uint64(3)).tolist(), centre.tolist(), sketch.tolist()))
    expected = []
    for i, w in enumerate(texts):
        values = substring_dedup._hash_values(substring_dedup.shingles(w, s.shingle), s)
        for fn, own in enumerate(values):
            for _, c, _ in substring_dedup.compact_windows(own, width):
                code = 0
                for other in (v for f, v in enumerate(values) if f != fn):
                    for side in (other[max(0, c - s.beside) : c], other[c + 1 : c + 1 + s.beside]):
                        code = code << 16 | (min(side.tolist(), default=2**64 - 1) >> 20) & 0xFFFF
                expected.append((i, fn, c, code))
    assert len(got) > 100 and got == sorted(expected)


def test_looks_share_as_many_codes_as_counted():
    """What is found by bits of frequent codes and lists of the others is what counting all codes finds."""
    s, rng = substring_dedup.PassageSettings(), np.random.default_rng(62)
    side = s.least - s.shingle
    looks = rng.integers(0, 90, (80, 2 * side + 1)).astype("<u2") + np.arange(2 * side + 1, dtype="<u2") % 3 * 100
    looks[:, :20] = rng.integers(1000, 60000, (80, 20))
    looks[40:60] = looks[:20]
    looks[40:60, 3:6] = 1
    looks[:, side] = 500
    nodes = np.arange(80) // 2 * 10
    number, sharing = substring_dedup._sharing(nodes, looks, s)
    sets = [set(looks[number == i].reshape(-1).tolist()) - {500} for i in range(40)]
    different = [min(len(set(x[x != 500].tolist())) + 1 for x in looks[number == i]) for i in range(40)]
    needed = [max(2, -(-s.percent * max(0, side + 1 - (2 * side + 1 - n)) // 100) - 1) for n in different]
    for i in range(39):
        assert sharing(i).tolist() == [j for j in range(i + 1, 40) if len(sets[i] & sets[j]) >= max(needed[i], needed[j])]


def test_texts_go_on_as_words_and_meetings_gathered(spark, monkeypatch):
    """No table holds a text, and two texts have one row of meetings for each task, however often they met."""
    rng, kept = np.random.default_rng(63), {}
    word = lambda n: [f"v{i}" for i in rng.integers(0, 10**6, n)]
    shared = word(1000)
    data = [(d, " ".join([*word(20), *shared])) for d in range(3)]
    put = substring_dedup.materialize

    def materialize(df, label, **options):
        kept[label] = put(df, label, **options)
        return kept[label]

    monkeypatch.setattr(substring_dedup, "materialize", materialize)
    monkeypatch.setattr(substring_dedup, "discard", lambda *tables: None)
    out = substring_dedup.repeated_passages(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.start, r.end) for r in out} == {(d, 20, 1020) for d in range(3)}
    assert all("text" not in df.columns for df in kept.values())
    rows = kept["met"].where("b is not null").collect()
    assert len(rows) <= 3 * spark.sparkContext.defaultParallelism
    assert sum(len(r.anchors) for r in rows) > 200


def test_passage_twice_in_the_first_text(spark):
    rng = np.random.default_rng(5)
    word = lambda n: " ".join(f"v{i}" for i in rng.integers(0, 10**6, n))
    shared = word(60)
    data = [(1, f"{word(20)} {shared} {word(30)} {shared}"), (2, f"{word(10)} {shared}"), (3, f"{shared} {word(25)}")]
    out = substring_dedup.repeated_passages(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {(r.start, r.end) for r in out if r.doc_id == 1} == {(20, 80), (110, 170)}


def slow_secrets(text):
    found = []
    key = re.compile(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    found += [(m.start(), 0, m.end()) for m in key.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_base_secrets_are_exact(spark, docs, rows):
    more = [(90_001, "secret=token:abcdefgh PASSWORD: 'a1b2c3d4' ſecret=abcdefg"), (90_002, "é AKIA" + "A1" * 10 + " " + "ab12" * 8)]
    got = {r.doc_id: r for r in secret_scan.find_secrets(spark.createDataFrame([*rows, *more, (90_003, None)], "doc_id long, text string")).collect()}
    for d, t in [*rows, *more, (90_003, "")]:
        want = secret_scan.span_text(slow_secrets(t or ""))
        assert got[d].base == want and got[d].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(got[d].spans.split(","))


def test_crf_learns_and_viterbi_is_best():
    good, bad = ([[int(b) + k for b in secret_scan._BASE[:-1]]] for k in (1, 0))
    crf = secret_scan.train_crf([(good, [1])] * 20 + [(bad, [0])] * 20 + [(good + bad, [1, 0])] * 5)
    assert crf.decode(good) == [1] and crf.decode(bad) == [0]
    rng = np.random.default_rng(2)
    crf = secret_scan.Crf(rng.normal(size=(20, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    import itertools

    f = [[1, 5], [2, 9], [7, 0], [3, 3]]
    score = lambda t: crf.begin[t[0]] + sum(crf.emit[x, y] for fs, y in zip(f, t) for x in fs) + sum(crf.move[a, b] for a, b in zip(t, t[1:]))
    assert tuple(crf.decode(f)) == max(itertools.product(range(3), repeat=4), key=score)


def test_secrets_beyond_the_base_patterns(spark):
    """The CRF learns from base spans and finds keys that no pattern covers; plain text stays."""
    rng = np.random.default_rng(21)
    key = lambda n=20: "".join(rng.choice(list("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"), n))
    plain = ["the version 2024.10.1 of module alpha3 runs since 12:30", "see chapter12 and figure7b on page 310", "McDonald and iPhone owners met in Room101", "ratio: medium and colour=green for item0042x"]
    data = [(i, f"some words here {'password' if i % 2 else 'api_key'}: {key()} {plain[i % 4]}") for i in range(400)]
    data += [(1000 + i, f"some words here credential: {key()} {plain[i % 4]}") for i in range(50)]
    data += [(2000 + i, f"{plain[i % 4]} {plain[(i + 1) % 4]}") for i in range(200)]
    got = {r.doc_id: r for r in secret_scan.find_secrets(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    found = sum(got[1000 + i].n_crf == 1 and got[1000 + i].n_assign == 0 for i in range(50))
    wrong = sum(got[i].n_crf for i in [*range(400), *range(2000, 2200)])
    assert found >= 45 and wrong <= 6, (found, wrong)


def test_redaction_keeps_everything_else(spark):
    data = [(1, "x password=b7db7aa4a5fcc78305 y", "k"), (2, "clean text", None), (3, None, "k")]
    out = secret_scan.redact(spark.createDataFrame(data, "doc_id long, text string, base string"))
    assert [(r.doc_id, r.text, r.base) for r in out.collect()] == [(1, "x [SECRET] y", "k"), (2, "clean text", None), (3, None, "k")]


def test_odd_and_empty_tables(spark, odd, nothing):
    labels = spark.createDataFrame([(5, 1), (7, 0), (7, None)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")
    for df, n in ((odd, len(ODD)), (nothing, 0)):
        assert quality_rules.host_quality(df).count() == n
        assert quality_classifier.score(df, quality_classifier.train(df, labels, F.lit(True))).count() == n
        langs = language_id.predict(df, language_id.train(df, F.lit(True))).collect()
        assert len(langs) == n and all(r.lang_pred == "und" for r in langs)
        assert decontaminate.leaks(df, items).count() == 0 and decontaminate.clean(df, items).count() == n
        scores = lm_scoring.pseudo_likelihood_scores(df).collect()
        assert len(scores) == n and all(np.isfinite(r.pll) for r in scores)
        assert minhash_dedup.near_duplicates(df).count() == n
        assert secret_scan.find_secrets(df).count() == n
        assert packing.pack(df).select("doc_id").distinct().count() == len({i for i, _ in ODD}) * bool(n)
        substring_dedup.repeated_passages(df).collect()
