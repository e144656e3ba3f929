"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

    score = sigmoid(b + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

so all pairwise interactions cost time linear in a text's words. It is fitted on the driver from at most
SAMPLE labelled rows (those with the smallest hashes of their ids), every text is scored whole on the
executors. Labels, language, source and id are never inputs.

Edge cases: a null text is empty; empty texts get a score from the intercept and their structure; a text is
scored whole, whatever its length; a null or wrong metadata value counts as the text's own length; repeated
rows get equal scores, and an id with several texts is learnt from once, by the text of the smallest hash; an
empty table gives an empty result; without labelled rows of both classes the score is the class's share (0.5
if none). The columns of docs stay, whatever their names, but for score and predicted, which the result's
replace.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.shared import others
from tidewheel.session import ship

#: Labelled rows that a fit uses at most.
SAMPLE = 8000
DIMS, RANK = 1 << 15, 8
THRESHOLD = 0.7
#: Words remembered by a worker before it forgets them all.
MOST_WORDS = 100_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        self[word] = at = zlib.crc32(word) % DIMS
        return at


_HASHES = _Hashes()
_KINDS = np.zeros((256, 10), np.float64)
for _i, _set in enumerate([b" ", b"\n", b"0123456789", bytes(range(65, 91)), bytes(range(97, 123)), b".,;:", b"!?", b"#$%&*@^~", b"|<>{}[]()/\\=_+-", bytes(range(128, 192))]):
    _KINDS[list(_set), _i] = 1
STATS = 10 + 10


def features(text: str | None, n_chars: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words, their values (of length 1 together), and statistics."""
    raw = (text or "").encode()
    n = max(len(raw), 1)
    words = raw.lower().split()
    ids = np.fromiter(map(_HASHES.__getitem__, words), np.int64, len(words))
    unique, counts = np.unique(ids, return_counts=True)
    values = np.log1p(counts)
    values = values / max(float(np.sqrt((values**2).sum())), 1e-9)
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _KINDS / n
    lines = [x for x in raw.split(b"\n") if x]
    m = max(len(words), 1)
    told = float(n_chars) if n_chars is not None and np.isfinite(n_chars) and n_chars >= 0 else float(len(text or ""))
    rest = [
        np.log1p(len(words)) / 10, len(unique) / m, counts.max() / m if len(counts) else 0.0, float((ids[1:] == ids[:-1]).mean()) if len(ids) > 1 else 0.0, float((ids[2:] == ids[:-2]).mean()) if len(ids) > 2 else 0.0,
        1 - len(set(lines)) / max(len(lines), 1), np.log1p(len(lines)) / 5, len(raw) / m / 10, np.log1p(told) / 10, 1.0]
    return unique, values, np.concatenate([np.sqrt(shares), rest])


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    std: np.ndarray
    #: Whether labelled rows of both classes were there to learn from.
    learnt: bool = True

    def stats(self, s: np.ndarray) -> np.ndarray:
        return np.clip((s - self.mean) / self.std, -4, 4) / np.sqrt(STATS)

    def raw(self, ids: np.ndarray, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid and the sums over each row; rows are not empty."""
        vx = self.v[ids] * x[:, None]
        sums = np.add.reduceat(vx, starts, 0)
        return self.bias + np.add.reduceat(self.w[ids] * x, starts) + 0.5 * (sums**2 - np.add.reduceat(vx**2, starts, 0)).sum(1), sums

    def rows(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        stats = np.arange(DIMS, DIMS + STATS)
        ids = np.concatenate([y for a, _, _ in parts for y in (a, stats)])
        x = np.concatenate([y for _, b, s in parts for y in (b, self.stats(s))])
        return ids, x, np.concatenate([[0], np.cumsum([len(a) + STATS for a, _, _ in parts])[:-1]]).astype(np.int64)

    def scores(self, parts: list) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*self.rows(parts))[0], -30, 30))) if parts else np.zeros(0)


def fit(parts: list, labels: np.ndarray, epochs: int = 8, batch: int = 256, rate: float = 0.02, decay: float = 2e-3, seed: int = 7) -> Machine:
    """Adam on the logistic loss; the same rows in the same order give the same machine."""
    rng = np.random.default_rng(seed)
    share = float(labels.mean()) if len(labels) else 0.5
    s = np.array([p[2] for p in parts]) if parts else np.zeros((1, STATS))
    std = s.std(0)
    m = Machine(float(np.log((share + 1e-3) / (1 - share + 1e-3))), np.zeros(DIMS + STATS), rng.normal(0, 0.05, (DIMS + STATS, RANK)), s.mean(0), np.where(std > 1e-6, std, 1.0))
    if not len(labels) or not 0 < share < 1:
        m.v[:] = 0
        m.learnt = False
        return m
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (m.w, m.v)]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(parts))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            ids, x, starts = m.rows([parts[i] for i in rows])
            out, sums = m.raw(ids, x, starts)
            g = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - labels[rows]) / len(rows)
            of = np.repeat(np.arange(len(rows)), np.diff(np.append(starts, len(ids))))
            gx = g[of] * x
            gw = np.bincount(ids, gx, DIMS + STATS)
            each = gx[:, None] * (sums[of] - m.v[ids] * x[:, None])
            gv = np.stack([np.bincount(ids, each[:, f], DIMS + STATS) for f in range(RANK)], 1)
            step += 1
            m.bias -= rate * float(g.sum())
            for p, grad, (a, b) in ((m.w, gw + decay * m.w / len(rows), state[0]), (m.v, gv + decay * m.v / len(rows), state[1])):
                a *= 0.9
                a += 0.1 * grad
                b *= 0.999
                b += 0.001 * grad**2
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return m


def held_out(key: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", n_chars: str = "n_chars", label: str = "quality", sample: int = SAMPLE) -> Machine:
    """Fits on labelled rows that aren't held out; at most `sample` of them, whose ids are broadcast."""
    ship(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    known = known.groupBy(F.col(key).alias("_key")).agg(F.min(label).cast("double").alias("_y")).orderBy(F.xxhash64("_key"), "_key").limit(sample)
    picked = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"), F.col(n_chars).cast("double").alias("_n")).join(F.broadcast(known), F.col("_id") == F.col("_key"))
    # One row for each id, so that what reaches the driver is bounded by the sample.
    picked = picked.groupBy("_id", "_y").agg(F.min_by(F.struct("_text", "_n"), F.struct(F.xxhash64("_text"), "_text", "_n")).alias("_r")).select("_id", "_y", "_r.*")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [features(t, n) for t, n in zip(b["_text"], b["_n"], strict=True)]
            yield pd.DataFrame({"_id": b["_id"].astype(str), "_y": b["_y"], "ids": [g[0].astype(np.int32) for g in got], "x": [g[1].astype(np.float32) for g in got], "s": [g[2] for g in got]})

    rows = picked.mapInPandas(extract, "_id string, _y double, ids array<int>, x array<float>, s array<double>").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["_id"], r["_y"], r["ids"]))
    parts = [(np.array(r["ids"], np.int64), np.array(r["x"], np.float64), np.array(r["s"])) for r in rows]
    return fit(parts, np.array([r["_y"] for r in rows]))


def score_column(model: Machine, text: Column, n_chars: Column) -> Column:
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, chars in batches:
            out = []
            texts, chars = texts.tolist(), chars.tolist()
            for at in range(0, len(texts), 256):
                out.append(model.scores([features(t, n) for t, n in zip(texts[at : at + 256], chars[at : at + 256], strict=True)]))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return F.pandas_udf(run, "double")(text, n_chars.cast("double"))


def classify(docs: DataFrame, model: Machine, text: str = "text", n_chars: str = "n_chars", threshold: float = THRESHOLD) -> DataFrame:
    """Adds score and predicted to the rows of docs."""
    ship(docs.sparkSession)
    return docs.select(*others(docs, "score", "predicted"), score_column(model, F.col(text), F.col(n_chars)).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
