"""Language identification by unigrams over pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A text's likelihood is the sum,
over all ways to cut it into pieces, of the product of their probabilities. Pieces hold a space in front only
and no mark after a letter, so the sum falls apart into one factor for each word (marks after letters begin words
of their own), which a forward algorithm gives for all languages at once:
alpha[j] = sum over pieces that end at j of alpha[j - length] * p(piece). A worker remembers words' factors.

Learning is expectation and maximisation: words are counted by language in Spark, a backward pass gives each
piece's expected count among a word's segmentations, and the counts of all words make the next probabilities.
It uses a bounded sample: about SAMPLE documents a language, those with the smallest hashes of their ids and
texts. Languages' shares, over all documents that aren't held out, are the prior. Language, source and id are
never inputs of a prediction. What reaches the driver is a number for each language and piece.

Edge cases: a text that is null or has no letter (by Unicode) is `und` with score 0, as is every text if no
language is known; texts are scored whole, white space between words alike, whatever their length; a character
that is no piece is spelt by its bytes' pieces; words over WHOLE characters are learnt in parts; null languages
are not learnt from; repeated rows get equal results; an empty table gives an empty result. The columns of docs
stay, whatever their names, but for lang_pred and score, which the result's replace.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.quality import held_out
from tidewheel.llm.shared import materialise, others
from tidewheel.session import ship

#: Documents a language that a fit uses, about, and its rounds.
SAMPLE, ROUNDS = 2000, 3
#: What each piece's count starts from.
SMOOTH = 0.05
#: Longer words, and those with characters that are no pieces, are summed one by one, on a scale of their own.
WHOLE = 24
#: Words remembered by a worker before it forgets them all.
MOST_WORDS = 400_000
SPACE = "▁"
UNKNOWN = "und"
#: A letter, and the marks that begin a word of their own if they follow one; no piece goes over such a place.
LETTER, MARK = r"[^\W\d_²³¹]", ".,;:!?"
WORD = re.compile(rf" ?(?=\S)[{MARK}]*[^\s{MARK}]*(?:(?<!{LETTER})[{MARK}]+[^\s{MARK}]*)*")
CUT = re.compile(rf"[^{SPACE}]{SPACE}|{LETTER}[{MARK}]")

_CACHE: dict = {}


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


#: Base of the hash by which substrings find their pieces (64 bits; a wrong hit is as rare as a collision of two of them).
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Upper bits of a hash that tell where its pieces begin in the sorted table.
SLOT_BITS = 18


@dataclass
class Pieces:
    """A vocabulary: ids of the pieces, of bytes, the longest piece; the id `n` stands for no piece."""

    ids: dict[str, int]
    bytes_: list[int]
    longest: int
    n: int

    def __post_init__(self):
        hashes = _mixed(np.array([_hash_of(p) for p in self.ids], np.uint64))
        order = np.argsort(hashes)
        self.hashes, self.of = np.append(hashes[order], np.uint64(0)), np.append(np.array(list(self.ids.values()), np.int32)[order], np.int32(self.n))
        if (self.hashes[1:-1] == self.hashes[:-2]).any():
            raise ValueError("two pieces share a hash")
        slots = (hashes[order] >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        self.start = np.searchsorted(slots, np.arange(1 << SLOT_BITS))
        self.deepest = int(np.bincount(slots).max())

    def find(self, hashes: np.ndarray) -> np.ndarray:
        hashes = _mixed(hashes)
        out = np.full(hashes.shape, self.n, np.int32)
        at = self.start[(hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
        for step in range(self.deepest):
            here = np.minimum(at + step, len(self.of) - 1)
            out = np.where(self.hashes[here] == hashes, self.of[here], out)
        return out


def _mixed(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(29))) * BASE


def _hash_of(s: str) -> int:
    h = 0
    for c in s:
        h = (h * int(BASE) + ord(c)) % (1 << 64)
    return h


def pieces(path: str) -> Pieces:
    """The vocabulary of a model file; one for each worker."""
    if path not in _CACHE:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(len(model))
        ids = {model.id_to_piece(i): i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
        if any(CUT.search(p) for p in ids):
            raise ValueError("a piece goes over a place where words are cut")
        ids = {p: i for p, i in ids.items() if SPACE not in p[1:]}  # words have one space, in front
        _CACHE[path] = Pieces(ids, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], max(map(len, ids)), len(model))
    return _CACHE[path]


def _cut(v: Pieces, words: list[str]) -> np.ndarray:
    """Words of one length: ids of the pieces by where they begin, their length less one, and word."""
    m = len(words[0])
    codes = np.ascontiguousarray(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, m).T.astype(np.uint64))
    out = np.full((m, min(m, v.longest), len(words)), v.n, np.int32)
    hashes = np.zeros(codes.shape, np.uint64)
    for length in range(out.shape[1]):
        begins = m - length
        hashes = hashes[:begins] * BASE + codes[length:]
        out[:begins, length] = v.find(hashes)
    return out


def _forward(p, m: int, longest: int) -> list[np.ndarray]:
    """p(begin, length less one): probabilities by word (and language); alpha by end."""
    alpha = [np.ones_like(p(0, 0))]
    for j in range(1, m + 1):
        alpha.append(sum(alpha[j - length] * p(j - length, length - 1) for length in range(1, min(j, longest) + 1)))
    return alpha


def _backward(p, m: int, longest: int) -> list[np.ndarray]:
    beta = [np.ones_like(p(0, 0))]  # from the last end on
    for i in range(m - 1, -1, -1):
        beta.append(sum(p(i, length - 1) * beta[m - i - length] for length in range(1, min(m - i, longest) + 1)))
    return beta[::-1]


def spaced(word: str) -> str:
    return SPACE + word[1:] if word[0] == " " else word


def _spelt(v: Pieces, c: str) -> list[int]:
    return [v.bytes_[b] for b in c.encode()]


@dataclass
class Model:
    """log probabilities by piece and language, with a last row of minus infinity for no piece."""

    langs: list[str]
    prior: np.ndarray
    log_p: np.ndarray
    path: str

    def long_word(self, v: Pieces, word: str) -> np.ndarray:
        """The log likelihood of one word by language, with alphas on a scale that goes along."""
        k = len(self.langs)
        alphas, scale = [np.ones(k)], np.zeros(k)  # alphas of the last ends, divided by exp(scale)
        for j in range(1, len(word) + 1):
            here = np.zeros(k)
            for length in range(1, min(j, v.longest) + 1):
                found = v.ids.get(word[j - length : j])
                if found is not None:
                    here += alphas[-length] * np.exp(self.log_p[found])
                elif length == 1:
                    here += alphas[-1] * np.exp(self.log_p[_spelt(v, word[j - 1])].sum(0))
            top = np.maximum(here, 1e-300)
            alphas = [a / top for a in [*alphas, here][-v.longest :]]
            scale += np.log(top)
        return scale + np.log(np.maximum(alphas[-1], 1e-300))

    def words(self, words: list[str]) -> np.ndarray:
        """The log likelihood of each word (with its space in front) by language."""
        v = pieces(self.path)
        out = np.zeros((len(words), len(self.langs)))
        by_length: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            by_length[len(w)].append(i)
        for length, rows in by_length.items():
            if length > WHOLE:
                for i in rows:
                    out[i] = self.long_word(v, words[i])
                continue
            for at in range(0, len(rows), 4096):
                some = rows[at : at + 4096]
                ids = _cut(v, [words[i] for i in some])
                fine = (ids[:, 0] < v.n).all(0)
                for i in np.flatnonzero(~fine):
                    out[some[i]] = self.long_word(v, words[some[i]])
                if fine.any():
                    ids = np.ascontiguousarray(ids[:, :, fine])
                    out[np.array(some)[fine]] = np.log(_forward(lambda i, k, ids=ids: self.p[ids[i, k]], *ids.shape[:2])[-1])
        return out

    def __post_init__(self):
        self.p = np.exp(self.log_p)


def split_words(text: str) -> list[str]:
    """Words, a space in front of those that follow white space, as the text's start does; marks after letters begin words too."""
    return WORD.findall(" " + " ".join(text.split()))


def words_of(text: Column) -> Column:
    """split_words of a column."""
    return F.pandas_udf(lambda s: s.map(split_words), "array<string>")(text)


def _expected(path: str, p: np.ndarray, langs: list[str]):
    """Expected counts of pieces in words that were counted by language."""
    of = {x: k for k, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pieces(path)
        counts = np.zeros((v.n + 1, len(langs)))
        for batch in batches:
            by_length = defaultdict(list)
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                whole = spaced(word)
                for at in range(0, len(whole), WHOLE):
                    by_length[len(whole[at : at + WHOLE])].append((of[lang], whole[at : at + WHOLE], n))
            for rows in by_length.values():
                for at in range(0, len(rows), 4096):
                    lang, word, n = zip(*rows[at : at + 4096], strict=True)
                    lang, n = np.array(lang), np.array(n, np.float64)
                    ids = _cut(v, list(word))
                    probs = p[ids, lang]
                    for i, w in zip(*np.nonzero(ids[:, 0] == v.n), strict=True):  # spelt by bytes, whatever the segmentation
                        probs[i, 0, w] = 1.0
                        np.add.at(counts, (_spelt(v, word[w][i]), lang[w]), n[w])
                    m, longest = ids.shape[:2]
                    get = lambda i, k, probs=probs: probs[i, k]
                    alpha, beta = _forward(get, m, longest), _backward(get, m, longest)
                    share = np.zeros(ids.shape)
                    for length in range(1, longest + 1):
                        for i in range(m - length + 1):
                            share[i, length - 1] = alpha[i] * probs[i, length - 1] * beta[i + length] * (n / alpha[m])
                    met = share > 0
                    cell = (ids * len(langs) + lang)[met]
                    counts += np.bincount(cell, share[met], counts.size).reshape(counts.shape)
        piece, lang = np.nonzero(counts[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int64()), pa.array(lang, pa.int64()), pa.array(counts[piece, lang])], names=["piece", "lang", "n"])

    return run


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, rounds: int = ROUNDS, path: str | None = None) -> Model:
    """Learns from the text and language of rows that aren't held out."""
    ship(docs.sparkSession)
    path = path or vocabulary_path()
    known = docs.select(F.col(lang).alias("_lang"), F.col(text).alias("_text"), F.pmod(F.xxhash64(key, text), F.lit(1 << 20)).alias("_h")).where(F.col("_lang").isNotNull() & ~held_out(F.col(key)))
    shares = {r["_lang"]: r["n"] for r in known.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    langs, v = sorted(shares), pieces(path)
    total = sum(shares.values())
    p = np.full((v.n + 1, len(langs)), 1 / v.n)
    p[-1] = 0
    if langs:
        within = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, int(np.ceil(sample / shares[k] * (1 << 20))))]), F.col("_lang"))
        words = known.where(F.col("_text").isNotNull() & (F.col("_h") < within)).select("_lang", F.explode(words_of(F.col("_text"))).alias("_word"))
        words = materialise(words.groupBy("_lang", "_word").agg(F.count(F.lit(1)).alias("_n")))
        for _ in range(rounds):
            got = words.mapInArrow(_expected(path, p, langs), "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
            counts = np.full((v.n, len(langs)), SMOOTH)
            counts[got["piece"].to_numpy(), got["lang"].to_numpy()] += got["n"].to_numpy()
            p[:-1] = counts / counts.sum(0)
    with np.errstate(divide="ignore"):
        return Model(langs, np.log(np.array([shares[x] / total for x in langs])), np.log(p), path)


def predict(model: Model, text: Column) -> Column:
    """A struct of lang_pred and score, the language's share of the likelihood."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        numbers: dict[str, int] = {}
        factors = np.zeros((0, len(model.langs)))
        for texts in batches:
            texts = texts.tolist()
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for lo in range(0, len(texts), 256):
                told = [i for i in range(lo, min(lo + 256, len(texts))) if model.langs and texts[i] is not None and any(map(str.isalpha, texts[i]))]
                split = [split_words(texts[i]) for i in told]
                if len(numbers) > MOST_WORDS:
                    numbers.clear()
                    factors = factors[:0]
                new = list({w for words in split for w in words if w not in numbers})
                numbers.update(zip(new, range(len(numbers), len(numbers) + len(new)), strict=True))
                if new:
                    factors = np.concatenate([factors, model.words(list(map(spaced, new)))])
                for i, words in zip(told, split, strict=True):
                    total = factors[np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))].sum(0) + model.prior
                    share = np.exp(total - total.max())
                    best = int(share.argmax())
                    langs[i], scores[i] = model.langs[best], share[best] / share.sum()
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return F.pandas_udf(run, "lang_pred string, score double")(text)


def detect(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred and score to the rows of docs."""
    ship(docs.sparkSession)
    found = docs.select(F.struct(*others(docs, "lang_pred", "score")).alias("_row"), predict(model, F.col(text)).alias("_found"))
    return found.select("_row.*", "_found.lang_pred", "_found.score")
