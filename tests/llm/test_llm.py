"""The ten operators: SQL or brute force on whole small tables, and their edge cases."""

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import oracle
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm import ann, chat, exact, jaccard, licenses, mixing, packing, quality, queries, sharding, urlfilter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, n int, sig string"
LONG = "lorem ipsum " * 30_000
ODD = [
    (1, None, None, None, None, "k", 1, "s"), (2, "", "en", "src0", 0, "k", 1, "s"), (3, " \t\n", "en", "src0", 3, None, None, None), (4, LONG, "en", "src1", len(LONG), "k", 1, "s"),
    (5, "All rights reserved. CC BY 4", "en", "src1", 28, "k", 1, "s"), (6, "All  rights\nreserved. CC BY 4", "en", "src1", 28, "k", 1, "s"), (7, "All rights reserved. CC BY 4", "de", "src2", 28, "k", 1, "s"),
    (7, "All rights reserved. CC BY 4", "de", "src2", 28, "k", 1, "s"), (None, "All rights reserved. CC BY 4", "de", "src2", 28, "k", 1, "s"), (8, "<|endoftext|> ünïcode 漢字 K", "de", "src2", 9, "k", 1, "s"),
]


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, con, name):
    assert not oracle.differences(queries.queries()[name](spark, SF), con, queries.oracle_sql()[name])


def test_chat_round_trip_and_edges(spark):
    rows = [(1, 0, "user", "a\\-b<|end|>\\"), (1, 1, "user", None), (1, None, "user", "first"), (1, 2, "assistant", "</s>[INST] x [/INST]<|"), (1, 2, "assistant", "</s>[INST] x [/INST]<|"), (1, 3, "assistant", ""), (2, 0, None, "x" * 100_000), (None, 0, "assistant", "<\\-|part|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.format_chats(df).select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("segments")).alias("loss")).collect()}
    for c in (1, 2, None):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(t.role, t.text) for t in out[c].turns] == [(r[2] or "", r[3] or "") for r in own]
        assert out[c].loss == "".join(r[3] or "" for r in own if r[2] == "assistant")
    assert out[1].formatted.count(chat.TURN) == 2
    assert chat.format_chats(df.limit(0)).count() == 0


def test_urls(spark):
    urls = [None, "", "no scheme", "http://NET/x", "http://x.net", "https://a.example.net/en/1", "http://example.net/de/1", "http://notnet/", "ftp://www.example.com/de/?q", "http://a.org/fr/#f", "http://a.org?x=/fr/", "x://y://net/"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge_urls(df).collect()}
    rules = spark.createDataFrame(list(urlfilter.RULES), "verdict string, host string, path string")
    assert got == {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge_by_join(df, rules).collect()}
    assert [got[i] for i in (3, 4, 5, 6, 7, 8, 9, 10)] == [("net/", "block"), (None, "allow"), ("example.net/en/", "allow"), ("net/", "block"), (None, "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), (None, "allow")]
    assert urlfilter.judge_urls(df.limit(0)).count() == 0


def test_url_collisions_do_not_decide(tmp_path, monkeypatch):
    monkeypatch.setattr(urlfilter, "xxh64_intdigest", lambda b: 7)
    urlfilter.build_index(urlfilter.RULES).tofile(tmp_path / "i")
    rules, verdicts = urlfilter.RuleIndex(str(tmp_path / "i")).judge(["a.net", "b.org", "c.com"], ["/", "/fr/x", "/"])
    assert rules == ["net/", "org/fr/", None] and verdicts == ["block", "allow", None]


def _links(texts, width, num, den):
    """The sets of all texts, and the pairs (places in texts) that link."""
    sets = [{tuple(w[j : j + width]) for j in range(max(len(w) - width + 1, 1))} if (w := re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) else set() for _, t in texts]
    inverted: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            inverted.setdefault(x, []).append(i)
    shared = Counter(p for own in inverted.values() for p in combinations(own, 2))
    return sets, [(a, b) for (a, b), c in shared.items() if den * c >= num * (len(sets[a]) + len(sets[b]) - c)]


def _components(texts, width, num, den):
    sets, links = _links(texts, width, num, den)
    up = list(range(len(texts)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return sorted((texts[i][0], len(sets[i]), texts[find(i)][0]) for i in range(len(texts)))


def _linked(texts, width, num, den):
    """(id, set size, smallest id of equal sets, links) of each text, and the pairs of classes that link; texts are sorted by id."""
    sets, links = _links(texts, width, num, den)
    own = {}
    for (i, _), s in zip(texts, sets, strict=True):
        if s:
            own.setdefault(frozenset(s), i)
    name = [own.get(frozenset(s), i) for (i, _), s in zip(texts, sets, strict=True)]
    degree = Counter(x for p in links for x in p)
    pairs = {tuple(sorted((name[a], name[b]))) for a, b in links if name[a] != name[b]}
    return sorted((texts[i][0], len(s), name[i], degree[i]) for i, s in enumerate(sets)), sorted(pairs)


def test_jaccard_against_brute_force(spark, con):
    docs = con.execute("SELECT doc_id, text FROM documents ORDER BY 1").fetchall()
    got = sorted(tuple(r) for r in queries.op3_ngram_jaccard(spark, SF).collect())
    assert got == _components(docs, 3, 90, 100)
    # A family of copies, each a few words from the next: chains, and pairs just beside the threshold.
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(200)]
    family, now = [], words
    for i in range(40):
        now = list(now)
        for at in rng.integers(0, 200, 1 + i % 4):
            now[at] = f"x{i}_{at}"
        family.append((i, " ".join(now)))
    df = spark.createDataFrame(family, "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.jaccard_components(df).collect()) == _components(family, 5, 8, 10)


def test_jaccard_edges(spark, odd, none):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(odd, width=3).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (5, 4, 5), (6, 4, 5), (7, 4, 5), (None, 4, None)} <= got
    assert jaccard.jaccard_components(none).count() == 0 and jaccard.keep_one(none).columns == none.columns


def _family(n):
    """Texts of near and equal words: chains of a few words' difference, every third text twice."""
    rng = np.random.default_rng(n)
    out, now = [], [f"w{i}" for i in range(120)]
    for i in range(n):
        now = list(now)
        for at in rng.integers(0, 120, i % 4):
            now[at] = f"x{i}_{at}"
        out += [" ".join(now)] * (2 if i % 3 == 0 else 1)
    return list(enumerate(out))


def test_every_link_is_counted(spark, con, monkeypatch):
    texts = con.execute("SELECT doc_id, text FROM documents ORDER BY 1").fetchall()
    got = jaccard.jaccard_links(spark.createDataFrame(texts, "doc_id long, text string"), width=3, num=90, den=100)
    assert sorted(tuple(r) for r in got.collect()) == _linked(texts, 3, 90, 100)[0]
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    texts = _family(60)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows, pairs = _linked(texts, 5, 8, 10)
    assert sorted(tuple(r) for r in jaccard.jaccard_links(df).collect()) == rows
    assert sorted(tuple(r) for r in jaccard.jaccard_pairs(df).collect()) == pairs


def test_links_of_odd_rows(spark, odd, none):
    got = sorted(((r.doc_id, r.n_shingles, r.class_id, r.n_links) for r in jaccard.jaccard_links(odd, width=3).collect()), key=str)
    assert {(1, 0, 1, 0), (2, 0, 2, 0), (3, 0, 3, 0), (5, 4, 5, 3), (6, 4, 5, 3), (None, 4, None, 0)} <= set(got)
    assert got.count((7, 4, 5, 3)) == 2 and len(got) == len(ODD)
    assert jaccard.jaccard_links(none).count() == 0 and jaccard.jaccard_pairs(none).count() == 0


def test_licenses(spark, con, odd, none):
    def places(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(j, k) for p, k in licenses.BASE.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        return len(w), len(at), min((a for a, _ in at), default=None), max((a for a, _ in at), default=None), ",".join(sorted({k for _, k in at}))

    docs = con.execute("SELECT doc_id, text FROM documents").fetchall()
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in queries.op4_license_scan(spark, SF).collect()}
    assert got == {i: places(t) for i, t in docs}
    rows = licenses.scan_licenses(odd).collect()
    assert sorted((r.n_words, r.n_base) for r in rows) == sorted(places(t)[:2] for _, t, *_ in ODD)
    assert licenses.scan_licenses(none).count() == 0


def test_edited_licenses(spark):
    rows, want = [("Licensed under the Apache License 2.0", "apache-2.0", 5 / 7), ("Released under the terms of the MIT License", "mit", 1.0), ("with or without", "bsd-text", None)], []
    for label, phrase in licenses.TEMPLATES.items():
        w, votes = phrase.split(), len(phrase.split()) - 1
        for i in range(1, len(w) - 1):
            rows += [(" ".join([*w[:i], "zzz", *w[i:]]), label, (votes - 1) / votes), (" ".join([*w[:i], *w[i + 1 :]]), label, (votes - 2) / votes), (" ".join([*w[:i], "zzz", *w[i + 1 :]]), label, (votes - 2) / votes)]
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    for i, (text, label, share) in enumerate(rows):
        found = label in got[i].labels.split(",")
        assert found == (share is not None and share >= licenses.SHARE), text
        assert not found or got[i].score >= share - 1e-12, text
    assert got[2].score == 0


def test_packing_round_trip(spark, odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_paths()[0])
    rows = packing.pack(odd).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0 for r in rows)
    for i, text, *_ in ODD:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: (r.start, r.sequence_id))
        times = sum(x[0] == i for x in ODD)
        assert b"".join(bytes(r.ids) for r in own[::times]) == np.array(ids, "<u4").tobytes() or times > 1
        assert sum(r.length for r in own) == times * len(ids)
    assert packing.pack(none).count() == 0
    assert packing.pieces(5000) == [(0, 2048), (2048, 2048), (4096, 512), (4608, 256), (4864, 128), (4992, 8)]


def test_quality(spark, odd, none):
    model = quality.train(odd, spark.createDataFrame([(5, 1), (2, 0), (3, None)], "doc_id long, quality int"))
    rows = quality.classify(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert quality.classify(none, model).count() == 0
    assert quality.train(none, spark.createDataFrame([], "doc_id long, quality int")).scores([quality.features(None, None)]).tolist() == [pytest.approx(0.5)]


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    m = quality.Machine(0.3, rng.normal(size=quality.DIMS + quality.STATS), rng.normal(size=(quality.DIMS + quality.STATS, quality.RANK)), np.zeros(quality.STATS), np.ones(quality.STATS))
    ids, x = np.array([3, 8, 11]), np.array([0.5, -1.0, 2.0])
    pairs = sum((m.v[a] @ m.v[b]) * p * q for (a, p), (b, q) in combinations(zip(ids, x, strict=True), 2))
    assert m.raw(ids, x, np.array([0]))[0][0] == pytest.approx(0.3 + (m.w[ids] * x).sum() + pairs)


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op6_quality(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean(np.array(good)[:, None] > np.array(bad)) > 0.98
    assert np.mean([r.predicted for r in rows if r.quality == 1]) > 0.98


def test_exact_edges(spark, odd, none):
    rows = exact.exact_dedup(odd).collect()
    same = [r for r in rows if r.group_size == 5]
    assert len(same) == 5 and {r.keep_id for r in same} == {5} and [r.doc_id for r in same if r.kept] == [5]
    assert {(r.doc_id, r.keep_id, r.kept) for r in rows if r.doc_id in (1, 2, 3)} == {(1, 1, True), (2, 1, False), (3, 3, True)}
    weak = exact.exact_dedup(odd, hashed=lambda t: F.lit(b"one"))
    assert sorted(map(str, weak.collect())) == sorted(map(str, rows))
    kept = exact.keep_first(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5, 8]
    twice = spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, text string")
    assert exact.keep_first(twice).count() == 1 and sum(r.kept for r in exact.exact_dedup(twice).collect()) == 1
    assert exact.exact_dedup(none).count() == 0 and exact.keep_first(none).count() == 0


def test_mixing(spark, odd, none):
    leaves = spark.createDataFrame([("d", "en", "a", 100), ("d", "en", "b", 1000), ("d", "de", "c", 10), ("e", "en", "f", 500)], "_l0 string, _l1 string, _l2 string, _tokens long")
    got = {r._l2: r._allow for r in mixing.allowances(leaves, 3, [{}, {}, {}], 1000, 1).collect()}
    assert got == {"a": 100, "b": 390, "c": 10, "f": 500}  # c's shortage goes to its language's siblings, a's to b
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), (F.col("id") % 50 + 1).alias("t"))
    out = mixing.mix(docs, [F.col("source")], [{"a": 1.0, "b": 3.0}], 0.5, tokens=F.col("t"), epochs=2).collect()
    total, used = sum(i % 50 + 1 for i in range(3000)), Counter()
    for r in out:
        used[r.source] += r.t
    assert 0.124 * total - 50 <= used["a"] <= 0.125 * total and 0.374 * total - 50 <= used["b"] <= 0.375 * total
    again = mixing.mix(docs.repartition(7), [F.col("source")], [{"a": 1.0, "b": 3.0}], 0.5, tokens=F.col("t"), epochs=2).collect()
    assert sorted((r.doc_id, r.epoch) for r in again) == sorted((r.doc_id, r.epoch) for r in out)
    everything = mixing.mix(odd, queries.mix_levels(), queries.MIX_WEIGHTS, 1.0, epochs=1)
    assert everything.count() == len(ODD)
    assert mixing.mix(none, queries.mix_levels(), queries.MIX_WEIGHTS, 0.5).count() == 0


def test_sharding(spark, odd, none):
    rows = queries.op9_sharding(spark, SF).collect()
    for s in range(16):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.grown_shard in (r.shard, 16) for r in rows)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r.size == len((texts[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in rows)
    heavy = Counter(r.shard for r in sharding.assign_shards(spark.range(20_000).withColumnRenamed("id", "doc_id"), [1.0, 3.0]).collect())
    assert 0.23 < heavy[0] / 20_000 < 0.27
    shared = spark.range(3000).select(F.lit(7).alias("doc_id"), F.col("id").alias("size"))
    assert sorted(r.slot for r in sharding.assign_shards(shared, [1.0, 1.0], order=["size"]).collect()) == list(range(3000))
    assert sharding.assign_shards(odd, [1.0, 1.0]).count() == len(ODD) and sharding.assign_shards(none, [1.0]).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(1500, 8)).astype(np.float32)
    v[100:400] = v[100]
    rows = [(i, v[i].tolist()) for i in range(1500)] + [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [None] * 8), (2080, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got: dict = {}
    for r in ann.neighbours(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 1500, 20))
    x, hits = v.astype(np.float64), []
    for q, found in got.items():
        s = (x * x[q]).sum(-1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -s))[:20]
        assert [r for r, *_ in sorted(found)] == list(range(1, 21)) and all(s[i] == pytest.approx(c, abs=1e-12) for _, i, c in found)
        hits.append(len({i for _, i, _ in found} & set(best.tolist())) / 20)
    assert np.mean(hits) >= 0.9
    assert ann.neighbours(df.limit(0), F.lit(True)).count() == 0
    few = ann.neighbours(df.where("vec_id < 5"), F.col("vec_id") == 0).collect()
    assert len(few) == 4


def test_neighbours_of_a_lone_group(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(size=(1200, 8)) + 9, rng.normal(size=(6, 8)) * 0.01 - 50]).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = ann.neighbours(df, F.col("vec_id").isin(0, 1200, 1203)).collect()
    assert Counter(r.query_id for r in got) == {0: 20, 1200: 20, 1203: 20}
    x = v.astype(np.float64)
    s = (x * x[1200]).sum(-1)
    s[1200] = -np.inf
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 1200] == np.lexsort((np.arange(len(v)), -s))[:20].tolist()


@pytest.mark.parametrize("kind", ["noise", "skewed norms"])
def test_neighbours_read_all_lists_within_the_ratio(spark, kind):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(1600, 1024))
    if kind == "skewed norms":
        v[7] *= 30
    top = float(np.sqrt((v**2).sum(1)).max())
    graph = ann.Graph.over(ann._level(v, top)[:1500])
    asked = v[1500::10]
    schema = T.StructType([T.StructField("_q", T.LongType()), T.StructField("_v", T.ArrayType(T.DoubleType()))])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(asked)), pa.int64()), pa.array(asked.tolist(), pa.list_(pa.float64()))], names=["_q", "_v"])
    rows = pa.Table.from_batches(ann._cells(graph, top, 0.11, schema)(iter([batch]))).to_pandas()
    got = [rows["_list"][rows["_q"] == i].tolist() for i in range(len(asked))]
    x = np.pad(asked * (top / np.sqrt((asked**2).sum(1, keepdims=True))), ((0, 0), (0, 1)))
    d = np.sqrt(((x[:, None] - graph.centroids[None]) ** 2).sum(-1))
    want = [set(np.flatnonzero(row <= row.min() * 1.11).tolist()) for row in d]
    assert max(map(len, want)) > 512 and [set(ids) for ids in got] == want


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, before, SF).cache()
        assert docs.columns == before.columns, name
        if name == "exact":
            plain = {r.t: r.i for r in before.groupBy(exact.normalised(F.col("text")).alias("t")).agg(F.min("doc_id").alias("i")).collect()}
            assert sorted(plain.values()) == sorted(r.doc_id for r in docs.collect())
        if name == "near":
            rows = [(r.doc_id, r.text) for r in before.orderBy("doc_id").collect()]
            assert sorted(r.doc_id for r in docs.collect()) == sorted({c for *_, c in _components(rows, 5, 8, 10)})
        before = docs
    pieces = p.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}


@pytest.mark.parametrize("labels", [[], [(1, None), (2, None)], [(10**9, 1), (10**9 + 1, 0)], [(i, 0) for i in range(50)]])
def test_quality_stage_without_usable_labels(spark, tmp_path, labels):
    import corpus_pipeline as p

    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(r.doc_id for r in p.good_quality(spark, docs, str(tmp_path)).collect()) == sorted(r.doc_id for r in docs.collect())
