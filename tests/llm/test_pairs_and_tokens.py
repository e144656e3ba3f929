"""Hard negatives, languages and alignments against brute force, and their edge cases."""

import hashlib
import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewheel.llm import alignment, language, mining, queries

SF = "/root/testdata/sf0.001"


# Hard negatives


def mined(rows, anchors, positives, negatives, low, high):
    """rows: {id: (label, vector of Python integers)}."""
    out = []
    for a in sorted(anchors):
        score = {i: sum(x * y for x, y in zip(rows[a][1], v, strict=True)) for i, (_, v) in rows.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if rows[i][0] == rows[a][0]][:positives]:
            fine = [i for i in order if rows[i][0] != rows[a][0] and low * score[p] <= 100 * score[i] <= high * score[p]]
            out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(fine[:negatives], 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("kind", ["noise", "ties", "large", "groups"])
def test_hard_negatives_by_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(mining, "BLOCK", 500)
    monkeypatch.setattr(mining, "LEAF", 8)
    monkeypatch.setattr(mining, "ASKED", 9)
    rng = np.random.default_rng(3)
    span = {"noise": 40, "ties": 2, "large": 1 << 28, "groups": 5}[kind]  # large: scores beyond what doubles hold
    base = rng.integers(-span, span, (4, 5)) * 10 if kind == "groups" else np.zeros((4, 5), int)
    rows = {i: (int(rng.integers(0, 3)), (base[i % 4] + rng.integers(-span, span + 1, 5)).tolist()) for i in range(300)}
    df = spark.createDataFrame([(i, v, k) for i, (k, v) in rows.items()], "vec_id long, vector array<long>, label int").repartition(3)
    got = found(mining.hard_negatives(df, F.col("vec_id") % 10 == 0, positives=3, negatives=4))
    assert got == mined(rows, range(0, 300, 10), 3, 4, 30, 90) and got


def test_trees_open_few_leaves():
    rng = np.random.default_rng(0)
    x = np.concatenate([c + rng.integers(-3, 4, (200, 8)) for c in rng.integers(-200, 200, (16, 8))])
    x = x[mining.tree_order(x.astype(float))]
    ids, q = np.arange(len(x)), x[::97].copy()
    n = len(q)
    everyone = lambda r, a, b: np.ones((len(r), b - a), bool)
    ends = np.iinfo(np.int64)
    for low, high in ((np.full(n, ends.min + 1), np.full(n, ends.max)), (np.zeros(n, np.int64), (q**2).sum(1) // 2)):
        request, place, score, opened = mining.search(x, ids, q, low, high, 5, everyone)
        for r in range(n):
            want = sorted(((-int(s), i) for i, s in enumerate(x @ q[r]) if low[r] <= s <= high[r]))[:5]
            assert [(-s, i) for s, i in zip(score[request == r].tolist(), place[request == r].tolist(), strict=True)] == want
        assert opened < 0.5 * n * len(x) / mining.LEAF


def test_hard_negatives_of_odd_rows(spark):
    rows = [(0, [10, 0], 1), (1, [9, 0], 1), (2, [5, 0], 2), (2, [6, 0], 2), (3, None, 2), (4, [1], 2), (5, [7, None], 2), (6, [8, 0], None), (None, [8, 0], 2), (7, [], 2), (8, [1 << 31, 1 << 31], 2), (9, [-5, 0], 2), (2, [5, 0], 2), (10, [0, 0], 3), (20, [0, 1], 3), (30, [-1, 0], 4), (40, [1, 0], 4)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>, label int").withColumn("rank", F.lit("x")).withColumn("_score", F.lit(1))
    got = found(mining.hard_negatives(df, F.col("vec_id") % 10 == 0))
    assert got == mined({0: (1, [10, 0]), 1: (1, [9, 0]), 2: (2, [5, 0]), 9: (2, [-5, 0]), 10: (3, [0, 0]), 20: (3, [0, 1]), 30: (4, [-1, 0]), 40: (4, [1, 0])}, [0, 10, 20, 30, 40], 5, 10, 30, 90)
    assert (0, 1, 1, 2, 90, 50) in got
    none = mining.hard_negatives(df.limit(0), F.lit(True))
    assert none.count() == 0 and none.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert found(mining.hard_negatives(df.where("vec_id = 0"), F.lit(True))) == [] and found(mining.hard_negatives(df, F.lit(None).cast("boolean"))) == []
    for bad in ({"positives": 0}, {"low": 95}):
        with pytest.raises(ValueError):
            mining.hard_negatives(df, F.lit(True), **bad)


# Languages


def all_segmentations(v, p, word):
    total = np.zeros(p.shape[1])
    for cuts in itertools.product((False, True), repeat=len(word) - 1):
        parts = [""]
        for c, new in zip(word, (False, *cuts), strict=True):
            parts = [*parts, c] if new else [*parts[:-1], parts[-1] + c]
        one = np.ones(p.shape[1])
        for x in parts:
            one = one * (p[v.ids[x]] if x in v.ids else np.prod([p[i] for i in language._spelt(v, x)], 0) if len(x) == 1 else 0)
        total += one
    return total


def test_all_segmentations_are_summed():
    v = language.pieces(language.vocabulary_path())
    p = np.concatenate([np.random.default_rng(0).dirichlet(np.ones(v.n), 3).T, np.zeros((1, 3))])
    with np.errstate(divide="ignore"):
        model = language.Model(list("abc"), np.zeros(3), np.log(p), language.vocabulary_path())
    words = ["▁hello", "▁the", "▁x𐍈y", "ing", "▁", "▁Straße", ".", "▁abcabcabc", "漢字", "é"]
    assert np.allclose(model.words(words), np.log([all_segmentations(v, p, w) for w in words]))
    assert np.allclose(model.long_word(v, "▁hello"), model.words(["▁hello"])[0])
    longer = "▁" + "information" * 40
    whole = model.long_word(v, longer)
    assert np.isfinite(whole).all() and (whole < -300).all() and np.allclose(model.words([longer])[0], whole)
    assert language.split_words("Foo, bar.baz  5.6\tx...y\n Zip!?") == [" Foo", ",", " bar", ".baz", " 5.6", " x", "...y", " Zip", "!?"]
    # Of a text, the words' sums are those of the whole: no piece goes over a place where words are cut.
    text = "▁the,▁a"
    assert np.allclose(model.words(["▁the", ",", "▁a"]).sum(0), np.log(all_segmentations(v, p, text)))


def test_expected_counts_by_brute_force():
    v = language.pieces(language.vocabulary_path())
    p = np.concatenate([np.random.default_rng(1).dirichlet(np.ones(v.n), 2).T, np.zeros((1, 2))])
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"_lang": ["a", "b"], "_word": [" the", " thin"], "_n": [3, 2]})
    (out,) = language._expected(language.vocabulary_path(), p, ["a", "b"])(iter([batch]))
    got = {(r["piece"], r["lang"]): r["n"] for r in out.to_pylist()}
    want = Counter()
    for k, word, n in ((0, "▁the", 3), (1, "▁thin", 2)):
        cuts = [c for m in range(len(word)) for c in itertools.combinations(range(1, len(word)), m)]
        weights = []
        for c in cuts:
            parts = [word[a:b] for a, b in zip((0, *c), (*c, len(word)), strict=True)]
            weights.append((np.prod([p[v.ids[x], k] for x in parts]) if all(x in v.ids for x in parts) else 0.0, parts))
        total = sum(w for w, _ in weights)
        for w, parts in weights:
            for x in parts if w else ():
                want[(v.ids[x], k)] += n * w / total
    assert set(got) == set(want) and all(abs(got[c] - want[c]) < 1e-9 for c in want)


def test_held_out_languages(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op12_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(got) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.98 and all(0 <= r["score"] <= 1 for r in got)


def test_odd_texts_have_languages(spark):
    rows = [(1, "the cat and the dog " * 30, "en"), (3, "der Hund und die Katze " * 30, "de"), (5, None, "en"), (6, "", "de"), (7, "12 34 !?", "en"), (8, "the " * 50_000, None), (8, "the " * 50_000, None), (9, "x" * 5000, None), (10, "漢字 the cat", None), (None, "der Hund", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("old")).withColumn("a.b", F.lit(1)).withColumn("_row", F.lit(2))
    model = language.train(df)
    assert model.langs == ["de", "en", "fr"]
    out = language.detect(df, model)
    assert out.columns == ["doc_id", "text", "lang", "a.b", "_row", "lang_pred", "score"]
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in out.collect()]
    assert {(1, "en"), (3, "de"), (8, "en"), (10, "en")} <= {g[:2] for g in got} and [g for g in got if g[1] == "und"] == [(5, "und", 0.0), (6, "und", 0.0), (7, "und", 0.0)]
    assert len({g for g in got if g[0] == 8}) == 1 and all(0 <= g[2] <= 1 for g in got)
    nothing = language.train(df.where("lang is null"))
    assert nothing.langs == [] and {r["lang_pred"] for r in language.detect(df, nothing).collect()} == {"und"}
    assert language.detect(df.limit(0), model).count() == 0 and language.train(df.limit(0)).langs == []


# Alignments

ODD_TEXTS = [None, "", "Foo bar  baz\nQux\n\nZip <s> </s> <unk> ﬁ \t end ", "a▁b c", "<|endoftext|> x", " ", "\n", "x" * 3000, "日本語のテキスト 漢字\x1c \x85 it's 'S they'll 12,345.6 é́  q", "\nfoo\n bar \n\n\nq", "it 's  's x", "a\x00b﻿ c​ d", "a.b,c!?;: ..d x² .y 5.6,7", "word " * 20_000]


def aligned(rows):
    """Counts of each row by one pass over both token lists."""
    import public_tokenizers as P

    one, two = Tokenizer.from_file(P.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    one.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    level = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    out, held = [], Counter()
    for text in rows:
        raw, links, groups = (" " + (text or "")).encode(), [], []
        a, b = (one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)) if text else ([], [])
        said = [[bytes(level[c] for c in one.id_to_token(i)) for i in a], [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]]
        if text and b"".join(said[0]) == raw == b"".join(said[1]):
            ends = [np.cumsum([len(x) for x in s]).tolist() for s in said]
            shared, i, j, at = set(ends[0]) & set(ends[1]), 0, 0, [[], []]
            for end in sorted({*ends[0], *ends[1]}):
                links.append((a[i], b[j]))
                if ends[0][i] == end:
                    at[0].append(a[i])
                    i += 1
                if ends[1][j] == end:
                    at[1].append(b[j])
                    j += 1
                if end in shared:
                    groups.append("|".join(",".join(map(str, x)) for x in at))
                    at = [[], []]
        else:
            a = b = []
        held.update(set(links))
        out.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    return [(na, nb, ng, len(ls), sum(held[k] == top[k[0]] for k in ls), sum(held[k] for k in ls), sha) for na, nb, ng, ls, sha in out]


@pytest.mark.parametrize("split", [True, False])
def test_alignments_by_brute_force(spark, monkeypatch, split):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    if not split:  # whole texts as units, and counts too many to be sent out
        monkeypatch.setattr(alignment, "cuts_apart", lambda path: False)
        monkeypatch.setattr(alignment, "MOST_BROADCAST", 0)
        docs = docs.limit(20)
    docs = docs.unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(ODD_TEXTS * 2)], "doc_id long, text string"))
    rows = [tuple(r) for r in docs.withColumn("n_a", F.lit(1)).select("doc_id", "text").collect()]
    got = {r["doc_id"]: tuple(r[c] for c in (*alignment.RESULTS, "groups_sha256")) for r in alignment.align_tokenizers(docs.withColumn("n_a", F.lit(1)).repartition(3), chunk=500).collect()}
    want = dict(zip([k for k, _ in rows], aligned([t for _, t in rows]), strict=True))
    assert got == want


def test_alignments_of_few_rows(spark):
    docs = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "same text"), (2, None)], "doc_id long, text string")
    got = sorted(map(tuple, alignment.align_tokenizers(docs).collect()), key=str)
    assert len(got) == 4 and len({g[1:] for g in got if g[0] != 2}) == 1 and next(g for g in got if g[0] == 1)[6] == 3 * 2
    assert alignment.align_tokenizers(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        alignment.align_tokenizers(docs.withColumnRenamed("doc_id", "n_a"), key="n_a")
