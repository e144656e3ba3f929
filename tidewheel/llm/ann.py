"""Approximate nearest neighbours on balanced posting lists of two levels.

The upper level has about sqrt(n / LIST) cells, MOST_CELLS at most, whose centroids are fitted on a bounded
sample with one more component that levels the vectors' norms, so that near means a large inner product
whatever the norms are. Every vector is indexed: it finds its cells through an in-memory graph of centroids,
best first, and one near a boundary is replicated to all cells within (1 + REPLICATE) times the nearest one's
distance, COPIES at most. Large cells are cut into blocks of at most BLOCK components, and a block's queries
into parts of at most ASKED, so neither bounds a task. Queries, which are fewer, are held against all centroids
and read every cell within a ratio of their nearest distance.

The lower level stands inside a block: lists of about LIST vectors, fitted from the block itself, of which a
query reads those within a ratio. Where that spares less than half (noise has no near lists) the block is
read as a whole. Both ratios are measured, not set: the smallest one at which the true neighbours of sampled
vectors among the sample, or the block, stand in the lists read for the share AIM of them.

Scores are inner products in double precision, computed pair by pair on the original vectors. Equal vectors
are searched once: of each distinct vector only the k + 1 smallest ids can be among any query's k nearest, so
only those are indexed, and queries with equal vectors share one search. A query whose cells hold fewer than
k vectors reads all cells.

Edge cases: vectors that are null, zero, of another dimension than most (of the smaller one, if two tie), or
hold null or non-finite components take no part; of rows that repeat an id, the one with the smallest vector
counts, and the id asks if that row does; a query's own row is no candidate, though its equal copies are;
equal scores go to smaller ids; with fewer than k candidates all come back; an empty table gives an empty
result; columns but key, vector and those of is_query are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm.shared import materialise
from tidewheel.session import ship

#: Bounds of the fit: sampled vectors, and cells.
SAMPLE, MOST_CELLS = 30_000, 4096
#: Vectors of a list, about; components of a block's vectors and queries of its search at most, on average; scores held at once.
LIST, BLOCK, ASKED, AT_ONCE = 256, 1 << 22, 1 << 14, 1 << 22
REPLICATE, COPIES = 0.02, 3
#: The share of sampled true neighbours that a ratio has to reach, at each level.
AIM = 0.985
DEGREE = 12
#: Best-first search of vectors: centroids kept, opened at a step, and steps.
BEAM = (16, 2, 16)


@dataclass
class Graph:
    """Centroids, each linked with its nearest ones and a few far ones."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray
    #: The usual distance of a vector from its centroid; ratios are taken of no less, so that a vector on a centroid has company.
    usual: float = 0.0

    @staticmethod
    def over(centroids: np.ndarray, seed: int = 3) -> Graph:
        k = len(centroids)
        rng = np.random.default_rng(seed)
        d = ((centroids[:, None, :] - centroids[None]) ** 2).sum(-1) if k <= 512 else (centroids**2).sum(1)[:, None] + (centroids**2).sum(1)[None] - 2 * centroids @ centroids.T
        near = np.argsort(d, 1, kind="stable")[:, : min(DEGREE, k)]
        far = rng.integers(0, k, (k, 4))
        return Graph(centroids, np.concatenate([near, far], 1), rng.permutation(k)[: min(k, 16)])

    def search(self, x: np.ndarray, beam: tuple[int, int, int] = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """For each row of x: ids and distances of the centroids found, nearest first (-1 and infinity pad)."""
        k, n = len(self.centroids), len(x)
        width, at_once, hops = min(beam[0], k), *beam[1:]
        seen = np.zeros((n, k), bool)
        rows = np.arange(n)[:, None]
        norms = (self.centroids**2).sum(1)
        xx = (x**2).sum(1)[:, None]

        def distance(ids: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(xx + norms[ids] - 2 * np.einsum("nd,nmd->nm", x, self.centroids[ids]), 0))

        ids = np.broadcast_to(self.entries, (n, len(self.entries))).copy()
        seen[rows, ids] = True
        dist = distance(ids)
        opened = np.zeros(ids.shape, bool)
        for _ in range(hops):
            order = np.argsort(dist, 1, kind="stable")[:, :width]
            ids, dist, opened = ids[rows, order], dist[rows, order], opened[rows, order]
            closed = np.where(opened | (ids < 0), np.inf, dist)
            best = np.argsort(closed, 1, kind="stable")[:, :at_once]
            if not np.isfinite(closed).any():
                break
            opened[rows, best] = True
            fresh = self.links[np.maximum(ids[rows, best], 0)].reshape(n, -1)
            new = ~seen[rows, fresh]
            seen[rows, fresh] = True
            ids = np.concatenate([ids, np.where(new, fresh, -1)], 1)
            dist = np.concatenate([dist, np.where(new, distance(fresh), np.inf)], 1)
            # One node may be reached by two links at once: the second is an equal copy, left out below.
            opened = np.concatenate([opened, np.zeros(fresh.shape, bool)], 1)
            same = np.argsort(ids, 1, kind="stable")
            ids, dist, opened = ids[rows, same], dist[rows, same], opened[rows, same]
            twice = np.zeros(ids.shape, bool)
            twice[:, 1:] = ids[:, 1:] == ids[:, :-1]
            dist = np.where(twice | (ids < 0), np.inf, dist)
            ids = np.where(np.isinf(dist), -1, ids)
        order = np.argsort(dist, 1, kind="stable")[:, :width]
        return ids[rows, order], dist[rows, order]


def valid(vector: Column) -> Column:
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def _chunks(x: np.ndarray, rows: int = 1024) -> Iterator[np.ndarray]:
    return (x[at : at + rows] for at in range(0, len(x), rows))


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """k-means; a list over twice the mean size gives its place for one of two halves, so lists stay balanced."""
    rng = np.random.default_rng(seed)
    c = sample[rng.permutation(len(sample))[:k]].copy()
    for step in range(rounds):
        own = np.concatenate([((c**2).sum(1)[None] - 2 * x @ c.T).argmin(1) for x in _chunks(sample)])
        counts = np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        starts = np.flatnonzero(np.r_[True, own[order][1:] != own[order][:-1]])
        c[own[order][starts]] = np.add.reduceat(sample[order], starts, 0) / counts[own[order][starts]][:, None]
        if step < rounds - 2:
            small, large = np.argsort(counts, kind="stable"), np.argsort(-counts, kind="stable")
            for a, b in zip(small, large, strict=True):
                if counts[b] <= 2 * len(sample) / k or counts[a] > len(sample) / k / 2:
                    break
                members = sample[own == b]
                c[a] = members[rng.integers(0, len(members))]
    return c


def _level(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors with one more component that gives all the norm `top`: the nearest of them have the largest inner products."""
    return np.concatenate([x, np.sqrt(np.maximum(top**2 - (x**2).sum(1, keepdims=True), 0))], 1)


def _matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _as_query(x: np.ndarray, top: float) -> np.ndarray:
    """A query's length doesn't matter, so it takes the common one, with nothing in the last component."""
    return np.pad(x * (top / np.sqrt((x**2).sum(1, keepdims=True))), ((0, 0), (0, 1)))


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (c**2).sum(1)[None] - 2 * x @ c.T, 0))


def within(dist: np.ndarray, usual: float, ratio: float) -> np.ndarray:
    """Which centroids a query reads, by its distances to all of them."""
    return dist <= np.maximum(dist.min(1, keepdims=True), usual) * (1 + ratio) + 1e-9


def measured_ratio(vectors: np.ndarray, held: np.ndarray, to_query: np.ndarray, usual: float, asked: np.ndarray, k: int) -> float:
    """The ratio at which the share AIM of the asked vectors' k true neighbours stand in lists that are read.

    held: the lists of each vector (-1 for none), to_query: the asked vectors' distances to all centroids.
    """
    if len(vectors) < 2:
        return 0.0
    m = min(k, len(vectors) - 1)

    def nearest(rows: np.ndarray) -> np.ndarray:
        scores = -(vectors[rows] @ vectors.T)
        scores[np.arange(len(rows)), rows] = np.inf
        return np.argpartition(scores, m - 1, 1)[:, :m]

    lists = held[np.concatenate([nearest(rows) for rows in _chunks(asked, 32)])]
    reach = np.where(lists >= 0, to_query[np.arange(len(asked))[:, None, None], np.maximum(lists, 0)], np.inf).min(2)
    need = reach / np.maximum(np.maximum(to_query.min(1, keepdims=True), usual), 1e-12) - 1
    return float(max(np.quantile(need, AIM), 0.0)) + 1e-6


def _cells(graph: Graph, top: float, ratio: float | None, schema: T.StructType):
    """Rows with their cells (_list): of vectors the replicated ones, of queries (a ratio is given) those to read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = [f.name for f in schema.fields].index("_v")
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                x = _matrix(part.column(at))
                if ratio is None:
                    ids, dist = graph.search(_level(x, top))
                    keep = within(dist, graph.usual, REPLICATE) & (ids >= 0)
                    keep[:, COPIES:] = False
                    rows, places = np.nonzero(keep)
                    cells = ids[rows, places]
                else:
                    rows, cells = np.nonzero(within(_distances(_as_query(x, top), graph.centroids), graph.usual, ratio))
                own = part.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(cells.astype(np.int32), pa.int32())], names=[*own.schema.names, "_list"])

    return run


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Pair by pair, so that equal vectors have equal scores wherever they stand."""
    return (q * v).sum(-1)


def _best(q: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of q, row of v) of all that may be among the k best of each query: those no worse than the k-th by more than rounding."""
    rough = q @ v.T
    m = min(k, len(v))
    kth = -np.partition(-rough, m - 1, 1)[:, m - 1 : m]
    slack = 8 * q.shape[1] * np.finfo(np.float64).eps * np.sqrt((q**2).sum(1, keepdims=True)) * np.sqrt((v**2).sum(1).max())
    return np.nonzero(rough >= kth - slack)


def _lower_lists(v: np.ndarray, top: float, k: int, queries: int) -> tuple[np.ndarray, np.ndarray, float, float] | None:
    """Centroids of a block's lists, each vector's list, the usual distance and the ratio to read by; None where the block is better read as a whole."""
    lists = round(len(v) / LIST)
    if lists < 8 or queries < 2 * lists:  # the fit would cost more than it spares
        return None
    x = _level(v, top)
    rng = np.random.default_rng(11)
    centroids = fit_centroids(x[rng.permutation(len(x))[: 32 * lists]], lists, rounds=4)
    own = np.concatenate([_distances(some, centroids).argmin(1) for some in _chunks(x)])
    asked = rng.permutation(len(x))[:64]
    usual = float(np.median(_distances(x[asked], centroids).min(1)))
    to_query = _distances(_as_query(v[asked], top), centroids)
    ratio = measured_ratio(v, own[:, None], to_query, usual, asked, k)
    read = within(to_query, usual, ratio) @ np.bincount(own, minlength=lists) / len(x)
    return (centroids, own, usual, ratio) if read.mean() < 0.5 else None


def _search_block(k: int, top: float):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(vectors) and len(queries):
            v, own = _matrix(vectors["_v"]), vectors["_id"].to_numpy()
            asking, ids = _matrix(queries["_v"]), queries["_q"].to_numpy()
            lower = _lower_lists(v, top, k, len(asking))
            if lower is None:
                parts = [(np.arange(len(asking)), slice(None))]
            else:
                centroids, of, usual, ratio = lower
                reads = within(_distances(_as_query(asking, top), centroids), usual, ratio)
                parts = [(np.flatnonzero(reads[:, c]), np.flatnonzero(of == c)) for c in range(len(centroids))]
            for rows, members in parts:
                x, mine = v[members], own[members]
                step = max(16, AT_ONCE // max(len(x), 1))
                for at in range(0, len(rows) if len(x) else 0, step):
                    some = rows[at : at + step]
                    i, j = _best(asking[some], x, k)
                    found.append((ids[some][i], mine[j], _scores(asking[some][i], x[j])))
        q, i, s = (np.concatenate(c) if found else np.zeros(0, kind) for c, kind in zip(list(zip(*found, strict=True)) or [(), (), ()], (np.int64, np.int64, np.float64), strict=True))
        # Of a query's rows from all lists of the block the k best stay.
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        keep = place < k
        return pa.table({"_q": q[keep].astype(np.int64), "_id": i[keep].astype(np.int64), "_score": s[keep]})

    return run


def neighbours(rows: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """query_id, rank from 1, key, score: the k nearest found of each row for which is_query holds; keys are whole numbers."""
    if key.lower() in ("query_id", "rank", "score"):
        raise ValueError(f"{key} is the name of a result column")
    spark = rows.sparkSession
    ship(spark)
    fine = rows.where(valid(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_id"), F.col(vector).alias("_v"), F.coalesce(is_query, F.lit(False)).alias("_asks"))
    dims = fine.groupBy(F.size("_v").alias("_dim")).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "_dim").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], f"query_id long, rank int, {key} long, score double")
    fine = fine.where(F.size("_v") == dims[0]["_dim"])
    one = F.min(F.struct("_v", (~F.col("_asks")).alias("_silent"))).alias("_r")
    fine = materialise(fine.groupBy("_id").agg(one).select("_id", "_r._v", (~F.col("_r._silent")).alias("_asks")))
    nth = F.row_number().over(Window.partitionBy("_v").orderBy("_id"))
    index = materialise(fine.withColumn("_nth", nth).where(F.col("_nth") <= k + 1).select("_id", "_v", (F.col("_nth") == 1).alias("_first")))
    distinct = index.where("_first")
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    n, top, indexed = index.agg(F.count_if("_first"), F.max(norm), F.count(F.lit(1))).first()
    least = min(k + 1, indexed)
    picked = _matrix(distinct.orderBy(F.xxhash64("_id"), "_id").limit(sample).select("_v").toArrow()["_v"])
    cells = int(np.clip(round(np.sqrt(n / LIST)), 1, min(MOST_CELLS, len(picked))))
    graph = Graph.over(fit_centroids(_level(picked, top), cells))
    ids, dist = (np.concatenate(c) for c in zip(*map(graph.search, _chunks(_level(picked, top))), strict=True))
    graph.usual = float(np.median(dist[:, 0]))
    held = np.where(within(dist, graph.usual, REPLICATE), ids, -1)[:, :COPIES]
    asked = np.arange(min(len(picked), 400))
    ratio = measured_ratio(picked, held, _distances(_as_query(picked[asked], top), graph.centroids), graph.usual, asked, k)

    index = index.select("_id", "_v")
    cell = T.StructField("_list", T.IntegerType())
    placed = materialise(index.mapInArrow(_cells(graph, top, None, index.schema), T.StructType([*index.schema.fields, cell])))
    in_block = max(LIST, BLOCK // dims[0]["_dim"])
    sizes = placed.groupBy("_list").agg(F.ceil(F.count(F.lit(1)) / in_block).cast("int").alias("_blocks"))  # at most MOST_CELLS rows, as the parts

    # Queries with equal vectors share the search of the smallest id among them.
    asking = fine.where("_asks").select("_id", "_v")
    shared = materialise(asking.groupBy("_v").agg(F.min("_id").alias("_q")).select("_q", "_v"))
    best = Window.partitionBy("_q").orderBy(F.desc("_score"), "_id")

    def search(asked: DataFrame) -> DataFrame:
        parts = asked.groupBy("_list").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("_parts"))
        dealt = F.broadcast(materialise(sizes.join(parts, "_list")))
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        hashed = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        by = ["_list", "_block", "_part"]
        blocks = placed.join(dealt, "_list").select("_list", hashed("_id", "_blocks").alias("_block"), each("_parts").alias("_part"), "_id", "_v")
        asks = asked.join(dealt, "_list").select("_list", each("_blocks").alias("_block"), hashed("_q", "_parts").alias("_part"), "_q", "_v")
        found = blocks.groupBy(*by).cogroup(asks.groupBy(*by)).applyInArrow(_search_block(k + 1, top), "_q long, _id long, _score double")
        return materialise(found.groupBy("_q", "_id").agg(F.max("_score").alias("_score")).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1).drop("_r"))

    found = search(materialise(shared.mapInArrow(_cells(graph, top, ratio, shared.schema), T.StructType([*shared.schema.fields, cell]))))
    # Small cells may leave a query with fewer than k: it then reads all cells, block by block.
    enough = found.groupBy("_q").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    short = materialise(shared.join(enough, "_q", "left_anti"))
    if not short.isEmpty():
        more = search(short.withColumn("_list", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))))
        found = found.join(short.select("_q"), "_q", "left_anti").unionByName(more)
    members = asking.join(shared, "_v").select(F.col("_id").alias("query_id"), "_q")
    pairs = members.join(found, "_q").where("query_id <> _id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_score"), "_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("_id").alias(key), F.col("_score").alias("score"))
