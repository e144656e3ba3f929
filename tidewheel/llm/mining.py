"""Hard-negative mining by ball trees with branch and bound.

Rows are dealt by hash into blocks of at most about BLOCK components, and each block is ordered once into a
balanced ball tree (halved again and again between two far points, so a node is a range of the order). A task
holds one block's tree against one part of the anchors: for a ball with centre c and radius r the inner product
with a lies between a.c - |a|r and a.c + |a|r, so nodes whose bounds miss the score window, or lie strictly
beneath the kth score found so far, are never opened. Each request first dives to its most promising leaf, so
that there is a kth score to prune with, and then opens what is left by falling upper bounds. Bounds have slack
for rounding, scores are exact whole numbers, and ties at the kth score are opened, so the result is exact.

First the anchors look for their positives, then each anchor and positive for rows inside its window. A block
answers with k rows a request at most; a window over a request's answers ranks them.

Edge cases: rows with a null id or label, or a vector that is null, empty, of another dimension than most (of
the smaller one, if two tie) or holds nulls take no part, as do those whose squared length is 2**62 or more, as
scores could leave 64 bits; of rows that repeat an id the one with the smallest vector and label counts, and
the id is an anchor if that row is; equal scores go to smaller ids; an anchor without positives, a positive
score below zero (its window is empty) or a window without rows gives no rows; an empty table gives an empty
result; columns but id, label, vector and those of is_anchor are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.shared import materialise
from tidewheel.session import ship

#: Components of a block's vectors, rows of a leaf at most, anchors of a part on average.
BLOCK, LEAF, ASKED = 1 << 17, 64, 4096
#: Whole numbers up to here are exact as doubles, sums too.
EXACT = 1 << 53


def _halves(n: int) -> Iterator[list[tuple[int, int]]]:
    """The ranges of a tree's nodes over n rows, level by level."""
    level = [(0, n)]
    yield level
    while max(b - a for a, b in level) > LEAF:
        level = [half for a, b in level for half in ((a, (a + b) // 2), ((a + b) // 2, b))]
        yield level


def tree_order(x: np.ndarray) -> np.ndarray:
    """The order of rows in which every node of the tree is a range."""
    order = np.arange(len(x))
    levels = list(_halves(len(x)))
    for level in levels[:-1]:
        for a, b in level:
            own = x[order[a:b]]
            one = own[((own - own.mean(0)) ** 2).sum(1).argmax()]
            other = own[((own - one) ** 2).sum(1).argmax()]
            order[a:b] = order[a:b][np.argpartition(own @ (other - one), (b - a) // 2)]
    return order


class Tree:
    """A ball tree over rows that stand in its order."""

    def __init__(self, x: np.ndarray):
        self.levels = []
        for level in _halves(len(x)):
            centre = np.stack([x[a:b].mean(0) for a, b in level])
            radius = np.array([np.sqrt(((x[a:b] - c) ** 2).sum(1).max()) for (a, b), c in zip(level, centre, strict=True)])
            self.levels.append((centre, radius))
        self.leaves = level

    def bounds(self, q: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Below and above which no inner product of a row of q with a member of each node lies."""
        centre, radius = self.levels[level]
        length = np.sqrt((q**2).sum(1, keepdims=True))
        middle = q @ centre.T
        reach = length * radius + 1e-9 * length * (np.sqrt((centre**2).sum(1)) + radius) + 1e-6
        return middle - reach, middle + reach


def search(x: np.ndarray, ids: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, allowed: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For each row of q the k best rows of x (whole numbers, in tree order) with scores in [low, high]: request, row, score; and how many leaves were opened.

    allowed(requests, a, b): which of rows a to b each of the requests may take. Higher scores come first, then smaller ids.
    """
    exact = max(float((x.astype(np.float64) ** 2).sum(1).max()), float((q.astype(np.float64) ** 2).sum(1).max())) * 1.01 < EXACT
    xf, qf = x.astype(np.float64), q.astype(np.float64)
    tree, n = Tree(xf), len(q)
    none = np.iinfo(np.int64).min
    score = np.full((n, k), none)
    place = np.full((n, k), -1)
    opened = 0

    def look(leaf: int, asking: np.ndarray) -> None:
        nonlocal opened
        a, b = tree.leaves[leaf]
        got = (qf[asking] @ xf[a:b].T).astype(np.int64) if exact else q[asking] @ x[a:b].T
        fit = (got >= low[asking, None]) & (got <= high[asking, None]) & allowed(asking, a, b)
        scores = np.concatenate([score[asking], np.where(fit, got, none)], 1)
        places = np.concatenate([place[asking], np.where(fit, np.arange(a, b), -1)], 1)
        tie = np.where(places >= 0, ids[places], np.iinfo(np.int64).max)
        best = np.lexsort((tie, ~scores), axis=1)[:, :k]
        score[asking], place[asking] = np.take_along_axis(scores, best, 1), np.take_along_axis(places, best, 1)
        opened += len(asking)

    def each_leaf(leaves: np.ndarray, asking: np.ndarray) -> None:
        order = np.argsort(leaves, kind="stable")
        cuts = np.flatnonzero(np.diff(leaves[order])) + 1
        for part in np.split(order, cuts) if len(order) else ():
            look(int(leaves[part[0]]), asking[part])

    def promising(level: int, under: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of the level whose parents are open, inside the window and not beneath the kth score; and upper bounds."""
        least, most = tree.bounds(qf, level)
        kth = score[:, k - 1 : k]
        return under & (most >= low[:, None]) & (least <= high[:, None]) & ((kth == none) | (most >= kth)), most

    everyone, depth = np.arange(n), len(tree.levels)
    first = np.zeros(n, np.int64)
    for level in range(1, depth):
        both = np.stack([2 * first, 2 * first + 1], 1)
        least, most = (np.take_along_axis(m, both, 1) for m in tree.bounds(qf, level))
        inside = (most >= low[:, None]) & (least <= high[:, None])
        first = np.take_along_axis(both, np.where(inside, most, -np.inf).argmax(1)[:, None], 1)[:, 0]
    each_leaf(first, everyone)
    live = np.ones((n, 1), bool)
    for level in range(depth):
        live, most = promising(level, np.repeat(live, 2, 1) if level else live)
    live[everyone, first] = False
    order = np.argsort(np.where(live, -most, np.inf), 1, kind="stable")
    for at in range(int(live.sum(1).max(initial=0))):
        leaf = order[:, at]
        kth = score[:, k - 1]
        going = np.flatnonzero(live[everyone, leaf] & ((kth == none) | (most[everyone, leaf] >= kth)))
        if not len(going):
            break
        each_leaf(leaf[going], going)
    request, rank = np.nonzero(place >= 0)
    return request, place[request, rank], score[request, rank], opened


def _whole(vectors: pa.ChunkedArray) -> np.ndarray:
    return pa.concat_arrays(vectors.chunks).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(vectors), -1)


def _ordered(rows: pa.Table) -> pa.Table:
    """A block in its tree's order, told by _at."""
    rows = rows.sort_by("_id")
    order = pa.array(tree_order(_whole(rows["_v"]).astype(np.float64)))
    return rows.take(order).append_column("_at", pa.array(np.arange(len(rows)), pa.int64()))


def _positives(k: int):
    def run(block: pa.Table, anchors: pa.Table) -> pa.Table:
        out = {"_anchor": [], "_id": [], "_score": []}
        if len(block) and len(anchors):
            block = block.sort_by("_at")
            ids, labels = block["_id"].to_numpy(), block["_label"].to_numpy()
            own, wanted = anchors["_anchor"].to_numpy(), anchors["_label"].to_numpy()
            fit = lambda r, a, b: (labels[a:b] == wanted[r, None]) & (ids[a:b] != own[r, None])
            ends = np.iinfo(np.int64)
            request, place, score, _ = search(_whole(block["_v"]), ids, _whole(anchors["_v"]), np.full(len(own), ends.min + 1), np.full(len(own), ends.max), k, fit)
            out = {"_anchor": own[request], "_id": ids[place], "_score": score}
        return pa.table({c: pa.array(x, pa.int64()) for c, x in out.items()})

    return run


def _negatives(k: int, low: int, high: int):
    def run(block: pa.Table, anchors: pa.Table) -> pa.Table:
        out = {"_anchor": [], "_pid": [], "_ps": [], "_id": [], "_score": []}
        if len(block) and len(anchors):
            block = block.sort_by("_at")
            ids, labels = block["_id"].to_numpy(), block["_label"].to_numpy()
            own, unwanted = anchors["_anchor"].to_numpy(), anchors["_label"].to_numpy()
            pid, ps = anchors["_pid"].to_numpy(), anchors["_ps"].to_numpy()
            fit = lambda r, a, b: labels[a:b] != unwanted[r, None]
            at_least, at_most = (np.array([f(int(s)) for s in ps], np.int64) for f in (lambda s: -((-low * s) // 100), lambda s: high * s // 100))
            request, place, score, _ = search(_whole(block["_v"]), ids, _whole(anchors["_v"]), at_least, at_most, k, fit)
            out = {"_anchor": own[request], "_pid": pid[request], "_ps": ps[request], "_id": ids[place], "_score": score}
        return pa.table({c: pa.array(x, pa.int64()) for c, x in out.items()})

    return run


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, key: str = "vec_id", vector: str = "vector", label: str = "label") -> DataFrame:
    """rows: whole-number ids, labels and vectors. anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    A negative has another label and low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    spark = rows.sparkSession
    ship(spark)
    if positives < 1 or negatives < 1 or not 0 <= low <= high:
        raise ValueError("counts start at 1, and 0 <= low <= high")
    v = F.col(vector).cast("array<long>")
    square = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    fine = rows.select(F.col(key).cast("long").alias("_id"), v.alias("_v"), F.col(label).cast("long").alias("_label"), F.coalesce(is_anchor, F.lit(False)).alias("_asks"), square.alias("_s"))
    fine = fine.where(f"_id is not null and _label is not null and size(_v) > 0 and _s < {2.0**62!r}").drop("_s")  # a null component makes the square null
    dims = fine.groupBy(F.size("_v").alias("_dim")).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "_dim").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    one = F.min(F.struct("_v", "_label", (~F.col("_asks")).alias("_silent"))).alias("_r")
    fine = materialise(fine.where(F.size("_v") == dims[0]["_dim"]).groupBy("_id").agg(one).select("_id", "_r._v", "_r._label", (~F.col("_r._silent")).alias("_asks")))
    n, asking = fine.agg(F.count(F.lit(1)), F.count_if("_asks")).first()
    blocks, parts = max(1, -(-n * dims[0]["_dim"] // BLOCK)), max(1, -(-asking // ASKED))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    trees = fine.select(dealt("_id", blocks).alias("_block"), "_id", "_label", "_v").groupBy("_block").applyInArrow(_ordered, "_block int, _id long, _label long, _v array<long>, _at long")
    trees = materialise(trees)
    anchors = fine.where("_asks").select(F.col("_id").alias("_anchor"), "_label", "_v")

    def searched(asked: DataFrame, run, schema: str) -> DataFrame:
        """Every part of the anchors against every block."""
        left = trees.withColumn("_part", every(parts)).groupBy("_block", "_part")
        right = asked.withColumn("_part", dealt("_anchor", parts)).withColumn("_block", every(blocks)).groupBy("_block", "_part")
        return left.cogroup(right).applyInArrow(run, schema)

    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_score"), "_id"))
    near = searched(anchors, _positives(positives), "_anchor long, _id long, _score long").withColumn("_r", best("_anchor")).where(F.col("_r") <= positives)
    # Below zero the window is empty.
    near = near.where("_score >= 0").select("_anchor", F.col("_id").alias("_pid"), F.col("_score").alias("_ps"))
    asked = materialise(anchors.join(near, "_anchor"))
    found = searched(asked, _negatives(negatives, low, high), "_anchor long, _pid long, _ps long, _id long, _score long").withColumn("rank", best("_anchor", "_pid")).where(F.col("rank") <= negatives)
    return found.select(F.col("_anchor").alias("anchor_id"), F.col("_pid").alias("positive_id"), "rank", F.col("_id").alias("negative_id"), F.col("_ps").alias("positive_score"), F.col("_score").alias("negative_score"))
