"""Queries and stages against brute force on whole tables; columns and ids of the user's own."""

import re
import struct
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import LONG, ODD, DOCS, _components
from xxhash import xxh64_intdigest

import corpus_pipeline
from tidewheel.llm import ann, chat, exact, jaccard, licenses, mixing, packing, quality, queries, shared, sharding, urlfilter

SF, SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"
CORE = ("doc_id", "text", "lang", "source", "n_chars", "url", "vec_id", "embedding", "conv_id", "turn", "role")


def own_names() -> list[str]:
    """Every column name that the operators make, for the user to have it already."""
    found = {"row", "start", "length", "ids", "offset", "epoch", "score", "predicted", "slot", "shard", "grown_shard", "host", "path", "rule", "verdict", "n", "key", "value"}
    for f in Path(shared.__file__).parent.glob("*.py"):
        found |= set(re.findall(r'(?:alias|withColumn)\("(\w+)"', f.read_text())) | set(re.findall(r'"(_\w+)"', f.read_text()))
    found |= {"a.b", "a`b", "_row.text", "two words"}
    return sorted(n for n in {n.lower() for n in found} if n not in CORE and n[0] != "%")


def plain(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([r[:5] for r in ODD], "doc_id long, text string, lang string, source string, n_chars long")


def clashing(df, names=None):
    return df.select("*", *[F.lit("user").alias(n) for n in (own_names() if names is None else names) if n not in df.columns])


KEEPERS = {
    "exact": (exact.keep_first, ()),
    "near": (lambda d: jaccard.keep_one(d, width=3), ()),
    "mixing": (lambda d: mixing.mix(d, queries.mix_levels(), queries.MIX_WEIGHTS, 0.9, epochs=2), ("epoch",)),
    "sharding": (lambda d: sharding.assign_shards(d, [1.0, 2.0], order=["text"], grow_by=1.0), ("shard", "slot", "grown_shard")),
    "quality": (lambda d: quality.classify(d, quality.train(d, d.sparkSession.createDataFrame([(5, 1), (2, 0)], "doc_id long, quality int"))), ("score", "predicted")),
    "urls": (lambda d: urlfilter.judge_urls(d.withColumn("url", F.lit("http://a.net/"))), ("host", "path", "rule", "verdict")),
    "urls by join": (lambda d: urlfilter.judge_by_join(d.withColumn("url", F.lit("http://a.net/")), d.sparkSession.createDataFrame(list(urlfilter.RULES), "verdict string, host string, path string")), ("host", "path", "rule", "verdict")),
}


@pytest.mark.parametrize("name", sorted(KEEPERS))
def test_columns_of_any_name_stay(spark, odd, name):
    f, results = KEEPERS[name]
    out = f(clashing(odd))
    extra = [n for n in own_names() if n not in results]
    assert len(extra) > 60 and set(extra) <= set(out.columns) and len(out.columns) == len({c.lower() for c in out.columns})
    rows = out.collect()
    assert all(r[c] == "user" for r in rows for c in extra)
    assert plain(out.select(*odd.columns, *results)) == plain(f(odd).select(*odd.columns, *results))


READERS = {
    "exact": exact.exact_dedup, "jaccard": jaccard.jaccard_components, "links": jaccard.jaccard_links, "licenses": licenses.scan_licenses,
    "pack": lambda d: packing.pack(d).drop("sequence_id", "batch_id")}


@pytest.mark.parametrize("name", sorted(READERS))
def test_other_columns_do_not_matter(odd, name):
    assert plain(READERS[name](clashing(odd))) == plain(READERS[name](odd))


def test_other_columns_of_chats_and_vectors(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    assert plain(chat.format_chats(clashing(rows))) == plain(chat.format_chats(rows))
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)], "vec_id long, embedding array<float>")
    assert plain(ann.neighbours(clashing(vectors), F.col("vec_id") % 20 == 0)) == plain(ann.neighbours(vectors, F.col("vec_id") % 20 == 0))
    with pytest.raises(ValueError):
        ann.neighbours(vectors.withColumnRenamed("vec_id", "rank"), F.lit(True), key="rank")
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, "a")], "start long, text string"), key="start")


def test_keys_that_tables_of_bits_hold(spark, monkeypatch):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("_row"))
    gone = shared.materialise(docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("_k0")))
    want = [i for i in range(5000) if i % 3]
    for most in (shared.MOST_BITS, shared.CHUNK, 64):  # 64 bits hold no table: all rows meet the keys in one shuffle
        monkeypatch.setattr(shared, "MOST_BITS", most)
        assert bool(shared.KeyFilter(gone, "_k0").bits) == (most > 64)
        assert sorted(r.doc_id for r in shared.without(docs, gone, [F.col("doc_id")], ["_k0"]).collect()) == want
    monkeypatch.setattr(shared, "MOST_BITS", 64)
    texts = [(i, f"{chr(97 + i % 9) * 3} b c d e f g h") for i in range(40)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard.keep_one(df).collect()) == sorted({c for *_, c in _components(texts, 5, 8, 10)})


def family(n, seed, length=120):
    rng = np.random.default_rng(seed)
    words, out = [f"w{i}" for i in range(length)], []
    for i in range(n):
        now = list(words)
        for at in rng.integers(0, length, int(rng.integers(1, 8))):
            now[at] = f"x{int(rng.integers(0, 30))}_{at}"
        out.append((i, " ".join(now[: int(rng.integers(length - 15, length))])))
    return out


def test_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    for seed in (1, 2):
        texts = family(120, seed)
        got = sorted(tuple(r) for r in jaccard.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string")).collect())
        assert got == _components(texts, 5, 8, 10)


def test_a_pair_leaves_the_join_of_buckets_few_times(spark, monkeypatch):
    texts = family(120, 3)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    t = jaccard.Threshold(8, 10, 0.25)
    sets, nodes, meet, stars = jaccard.prepared(df, "doc_id", "text", 5, t)
    plain_distinct, left = type(df).distinct, []

    def counted(self):
        left.extend([self.count()] if self.columns == ["a", "b"] else [])
        return plain_distinct(self)

    monkeypatch.setattr(type(df), "distinct", counted)
    pairs = jaccard.across_components(meet.withColumn("comp", F.col("node")), nodes, t)
    monkeypatch.undo()
    ids = {r.node: r.key for r in nodes.select("node", "key").collect()}
    found = {tuple(sorted((ids[r.a], ids[r.b]))) for r in pairs.union(stars).collect()}
    own = {i: set(jaccard.shingles(x, 5).tolist()) for i, x in texts}
    links = {(i, j) for i in own for j in own if i < j and 10 * len(own[i] & own[j]) >= 8 * len(own[i] | own[j]) and own[i] != own[j]}
    assert links and links <= found
    assert left[0] <= 4 * pairs.count()


def test_buckets_are_merged_only_where_that_spares_comparisons(spark):
    alike = [(token, 0, node, 7, 7) for token in range(100, 110) for node in range(1, 9 + token % 2)]
    apart = [(token, 50, 3 * token + i, 7, 7) for token in range(200, 210) for i in range(3)]
    rest = spark.createDataFrame(alike + apart, "token long, p long, node long, band int, own int")
    assert sorted(tuple(r) for r in jaccard.merged_buckets(rest).collect()) == [(token, 7, 0) for token in range(100, 110)]


def test_license_words_are_split_without_matches(spark, capsys):
    texts = [None, "", " ", "--", "CC BY", " a", "a ", "\x00a\x7f  b\n", "\u00e9t\u00e9 x", "\U0001f600 b", "\u3000x", "\u212a k", "\u0130 i", "a.B,c9", "x--y_z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_words for r in licenses.scan_licenses(df).collect()}
    assert got == {i: len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", x or "")) for i, x in enumerate(texts)}
    licenses.scan_licenses(df).explain()
    plan = capsys.readouterr().out
    assert "split(" in plan and "regexp_extract_all" not in plan


def test_ids_with_several_texts_are_linked_by_each(spark):
    a, b = "one two three four five six seven eight nine ten eleven twelve", " ".join(f"v{i}" for i in range(60))
    near = b.replace("v59", "zz")
    rows = [(5, a), (5, b), (7, b), (9, near), (9, near), (1, "alone here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.jaccard_components(df).collect()) == [(1, 1, 1), (5, 8, 5), (5, 56, 5), (7, 56, 5), (9, 56, 5), (9, 56, 5)]
    assert sorted(tuple(r) for r in jaccard.keep_one(df).collect()) == [(1, "alone here"), (5, a), (5, b)]
    assert jaccard.keep_one(spark.createDataFrame([(3, b), (3, b)], "doc_id long, text string")).count() == 1


def test_vectors_under_repeated_ids(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 8)).astype(np.float32)
    rows = [(i % 380, v[i].tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.neighbours(df, F.col("vec_id") % 20 == 0).collect()
    one = {}
    for i, x in rows:
        one[i] = min(one.get(i, x), x)
    x = np.array([one[i] for i in range(380)], np.float64)
    for q in range(0, 380, 20):
        s = (x * x[q]).sum(-1)
        s[q] = -np.inf
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [(r.vec_id, r.score) for r in own] == [(int(i), pytest.approx(s[i], abs=1e-12)) for i in np.lexsort((np.arange(380), -s))[:20]]


def test_large_norms_lose_no_tie(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=64) * 1e4
    rows = [(i, np.roll(base, 0).tolist()) for i in range(3)] + [(i, (rng.normal(size=64) * 1e4).tolist()) for i in range(3, 300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [r for r in ann.neighbours(df, F.col("vec_id") == 0, k=2).collect()]
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == [1, 2] and got[0].score == got[1].score


def test_lower_lists_find_groups():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 16)) * 8
    v = (centres[rng.integers(0, 60, 9000)] + rng.normal(size=(9000, 16))).astype(np.float64)
    top = float(np.sqrt((v**2).sum(1)).max())
    assert ann._lower_lists(v, top, 21, 5000) is not None and ann._lower_lists(rng.normal(size=(4000, 64)), 12.0, 21, 4000) is None
    import pyarrow as pa

    vectors = pa.table({"_id": pa.array(range(9000), pa.int64()), "_v": pa.array(v.tolist(), pa.list_(pa.float64()))})
    asks = pa.table({"_q": pa.array(range(200), pa.int64()), "_v": pa.array(v[:200].tolist(), pa.list_(pa.float64()))})
    asks = pa.concat_tables([asks.set_column(0, "_q", pa.array(range(k * 200, k * 200 + 200), pa.int64())) for k in range(5)])
    got = ann._search_block(21, top)(vectors, asks).to_pandas()
    hits = []
    for q in range(200):
        true = set(np.argsort(-(v @ v[q]), kind="stable")[:21].tolist())
        hits.append(len(true & set(got["_id"][got["_q"] == q])) / 21)
    assert np.mean(hits) > 0.95


def test_recall_of_the_query(spark):
    """op10 itself, on whole tables of two sizes."""
    for sf in (SMALL, LARGE):
        rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
        rows = sorted((i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v))
        ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
        got, hits = defaultdict(list), []
        for r in queries.op10_neighbours(spark, sf).collect():
            got[r.query_id].append((r["rank"], r.vec_id, r.score))
        assert sorted(got) == [i for i in ids.tolist() if i % 20 == 0]
        place = {int(i): k for k, i in enumerate(ids)}
        for q, found in got.items():
            s = (x * x[place[q]]).sum(-1)
            assert [r for r, *_ in sorted(found)] == list(range(1, 21)) and all(s[place[i]] == pytest.approx(c, abs=1e-12) for _, i, c in found)
            assert [(-c, i) for _, i, c in sorted(found)] == sorted((-c, i) for _, i, c in found)
            s[place[q]] = -np.inf
            hits.append(len({i for _, i, _ in found} & set(ids[np.lexsort((ids, -s))[:20]].tolist())) / 20)
        assert np.mean(hits) >= 0.95


def _shard(key, weights, seed=0):
    def score(i, w):
        h = 42
        for part in (struct.pack("<i", seed), b"\0null" if key is None else str(key).encode(), struct.pack("<i", i)):
            h = xxh64_intdigest(part, h)
        return -np.log(((h >> 11) + 0.5) / float(1 << 53)) / w

    return min(range(len(weights)), key=lambda i: (score(i, weights[i]), i))


def test_every_shard_by_hand(spark):
    rows = queries.op9_sharding(spark, SMALL).collect()
    assert all((r.shard, r.grown_shard) == (_shard(r.doc_id, [1.0] * 16), _shard(r.doc_id, [1.0] * 17)) for r in rows) and len(rows) == 1000
    keys = spark.createDataFrame([(i,) for i in [None, *range(300)]], "doc_id long")
    for weights in ([1.0, 2.5, 0.5], [1.0 + i % 3 for i in range(70)], [1.0] * 300):  # 70 and 300 are scored by one function over an array
        got = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.assign_shards(keys, weights, grow_by=3.0).collect()}
        assert got == {i: (_shard(i, weights), _shard(i, [*weights, 3.0])) for i in [None, *range(300)]}


def test_every_score_pair_by_pair(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r.doc_id: r for r in queries.op6_quality(spark, SF).collect()}
    assert len(got) == len(docs) and known
    for d in docs:
        ids, x, _ = model.rows([quality.features(d.text, d.n_chars)])
        v = model.v[ids] * x[:, None]
        pairs = np.triu(v @ v.T, 1).sum()
        assert got[d.doc_id].score == pytest.approx(1 / (1 + np.exp(-np.clip(model.bias + model.w[ids] @ x + pairs, -30, 30))), abs=1e-9)
        assert got[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2)


def test_an_id_with_many_texts_is_learnt_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda parts, labels: seen.append(len(parts)) or quality.Machine(0.0, np.zeros(quality.DIMS + quality.STATS), np.zeros((quality.DIMS + quality.STATS, quality.RANK)), np.zeros(quality.STATS), np.ones(quality.STATS)))
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit(2).alias("n_chars"))
    quality.train(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert seen == [1]


def test_every_piece_by_the_tokenizer_file(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_paths()[0])
    got = defaultdict(list)
    rows = queries.op5_packing(spark, SMALL).collect()
    for r in rows:
        got[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    for d in docs:
        ids = np.array([*t.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4")
        assert sorted(got[d.doc_id]) == [(a, n, zlib.crc32(ids[a : a + n].tobytes()), len(ids)) for a, n in packing.pieces(len(ids))]
    assert len({r.sequence_id for r in rows}) == len(rows)
    batches = defaultdict(list)
    for r in rows:
        batches[r.batch_id].append(r)
    assert all(len({x.length for x in b}) == 1 and sum(x.length for x in b) <= packing.BATCH_TOKENS for b in batches.values())
    tasks = len({r.sequence_id >> packing.TASK_BIT & 0xFFFFFF for r in rows})
    assert sum(sum(x.length for x in b) < packing.BATCH_TOKENS for b in batches.values()) <= 12 * tasks
    assert all(r.bucket == r.length.bit_length() - 1 == r.sequence_id >> packing.BUCKET_BIT for r in rows)


def test_ties_long_and_repeated_urls(spark):
    rules = [("block", "b.com", "/xyz/"), ("allow", "a.b.com", "/xy"), ("allow", "c.org", "/"), ("block", "c.org", "/"), ("allow", "d.b.com", "/xy/")]
    urls = ["http://a.b.com/xyz/", "http://a.b.com/xyz/", "http://c.org/" + "p/" * 50_000, "http://" + "s." * 3000 + "c.org", None, "http://d.b.com/xyz/" + "q" * 100_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    frame = spark.createDataFrame(rules, "verdict string, host string, path string")
    for order in (rules, rules[::-1]):
        got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge_urls(df, order).collect()}
        assert got == {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge_by_join(df, frame).collect()}
    assert got[0] == got[1] == ("a.b.com/xy", "allow") and got[2] == ("c.org/", "block") and got[3] == (None, "allow") and got[5] == ("b.com/xyz/", "block")
    assert got[4] == (None, "allow")


def test_long_license_texts(spark):
    df = spark.createDataFrame([(1, "all rights reserved with or without " * 60_000)], "doc_id long, text string")
    r = licenses.scan_licenses(df).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == (360_000, 60_000, 0, 359_994, "reserved", "reserved")
    again = spark.createDataFrame([(1, "released under released under mit license license")], "doc_id long, text string")
    assert licenses.scan_licenses(again).first().labels == ""  # one place of the template, voted for twice, counts once


def test_large_template_sets_join(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain(licenses.scan_licenses(docs))
    monkeypatch.setattr(licenses, "MOST_BROADCAST", 1)
    assert plain(licenses.scan_licenses(docs)) == want


def test_domains_run_short(spark):
    """The first domain and the rarer languages of others can't use their shares; siblings get the rest."""
    rows = queries.op8_mixing(spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "source", "lang", mixing.utf8_tokens(F.col("text")).alias("t")).collect()
    domain = lambda s: f"src-{int(s[3:]) // queries.DOMAIN}"
    have, used = Counter(), Counter()
    for d in docs:
        have[domain(d.source)] += d.t
        have[domain(d.source), d.lang] += d.t
    for r in rows:
        used[domain(r.source)] += r.tokens
        used[domain(r.source), r.lang] += r.tokens
    total = sum(d.t for d in docs)
    assert len([k for k in have if isinstance(k, str)]) == 4
    assert used["src-0"] == 2 * have["src-0"] < queries.MIX_SHARE * total * 0.55
    assert used["src-1", "de"] == 2 * have["src-1", "de"] and used["src-1", "en"] < 2 * have["src-1", "en"]
    assert 0.9 * queries.MIX_SHARE * total <= sum(r.tokens for r in rows) <= queries.MIX_SHARE * total


def test_stages_by_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.good_quality(spark, docs, SF)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in queries.op6_quality(spark, SF).where("predicted = 1").collect())
    mixed = sorted(r.doc_id for r in corpus_pipeline.mixed(spark, docs, SF).collect())
    from hashlib import md5

    rows = [(f"src-{int(d.source[3:]) // 5}", d.lang, d.source, d.doc_id, -(-len((d.text or "").encode()) // 4) + 1) for d in docs.collect()]

    def fill(budget, members, level):
        """Shares by weight; whoever can't use its share takes all it has, and the rest is shared anew."""
        if level == 3:
            return {members[0][2:3] and members[0][:3]: min(budget, sum(r[4] for r in members))}
        groups, out = defaultdict(list), {}
        for r in members:
            groups[r[level]].append(r)
        weight = {g: queries.MIX_WEIGHTS[level].get(g, 1.0) for g in groups}
        cap = {g: float(sum(r[4] for r in m)) for g, m in groups.items()}
        share, open_, left = {}, set(groups), budget
        while open_:
            rate = left / sum(weight[g] for g in open_)
            full = {g for g in open_ if cap[g] <= rate * weight[g]}
            for g in full or open_:
                share[g] = cap[g] if full else rate * weight[g]
            left -= sum(share[g] for g in full)
            open_ -= full or open_
        for g, m in groups.items():
            out |= fill(share[g], m, level + 1)
        return out

    want = []
    for leaf, allowed in fill(corpus_pipeline.TOKENS_KEPT * sum(r[4] for r in rows), rows, 0).items():
        own = [r for r in rows if r[:3] == leaf]
        room, n = int(allowed + 1e-6), sum(r[4] for r in own)
        if room >= n:
            want += [r[3] for r in own]
            continue
        for r in sorted(own, key=lambda r: md5(f"{queries.MIX_SEED}|0|{r[3]}".encode()).hexdigest()):
            room -= r[4]
            if room < 0:
                break
            want.append(r[3])
    assert mixed == sorted(want)


@pytest.mark.parametrize("kind", ["odd", "none", "clashing"])
def test_pipeline_edges(spark, tmp_path, odd, kind):
    docs = {"odd": odd, "none": odd.limit(0), "clashing": clashing(odd)}[kind]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    before = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, before, str(tmp_path))
        assert out.columns == before.columns
        before = shared.materialise(out)
    assert sorted(r.doc_id for r in before.collect()) == ([] if kind == "none" else [1, 3, 4, 5, 8])
    mark = shared.written()
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert shared.written() - mark == 4  # the four stages' rows: what they wrote on the way is gone
    assert {r.doc_id for r in rows} <= {1, 3, 4, 5, 8} and (kind == "none") == (not rows)


def test_no_folder_of_one_machine_on_a_cluster(spark):
    class Far:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master, applicationId = "spark://host:7077", "app"

    with pytest.raises(ValueError):
        shared.shared_dir(Far)


def test_a_third_of_all_rows_equal(spark, monkeypatch):
    """Slots stay gapless and the equal rows are numbered in parts; of a repeated row one stays, other rows of its key's bits too."""
    monkeypatch.setattr(sharding, "SPLIT", 500)
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 1, F.lit(7)).otherwise(F.col("id") % 3).alias("size"))
    rows = rows.withColumn("doc_id", F.when(F.col("size") == 7, F.lit(5)).otherwise(F.col("doc_id")))
    plain = Counter(rows.select("doc_id", "size").collect())
    seen = []
    whole = sharding.materialise
    monkeypatch.setattr(sharding, "materialise", lambda df: seen.append(whole(df)) or seen[-1])
    for weights in ([1.0], [1.0, 2.0, 1.0]):
        seen.clear()
        got = sharding.assign_shards(rows, weights, order=["size"]).collect()
        assert Counter((r.doc_id, r["size"]) for r in got) == Counter({tuple(k): v for k, v in plain.items()})
        for s in range(len(weights)):
            assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
        parts = seen[-1].groupBy("_key", "_part").count().collect()
        assert {r["_key"] for r in parts} == {None, 5} and max(r["count"] for r in parts) < 1500 and sum(r["count"] for r in parts) == 6000

    docs = spark.range(900).select(F.when(F.col("id") % 3 == 0, F.lit(1)).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id")).alias("k"), F.lit("x" * 50).alias("text"))
    repeated = shared.materialise(spark.createDataFrame([(1,)], "k long"))
    for most in (shared.MOST_BITS, 0):  # with a bit table, and without
        monkeypatch.setattr(shared, "MOST_BITS", most)
        left = Counter(r.k for r in shared.one_of_each(docs, repeated, [F.col("k")], ["k"]).collect())
        assert left == Counter({1: 1, None: 300, **{i: 1 for i in range(900) if i % 3 == 2}})
