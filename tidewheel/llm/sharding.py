"""Sharding by rendezvous hashing over weighted shards.

Each record takes the shard with the smallest -ln(u) / weight, where u in (0, 1) hashes its key and the
shard's number. A new shard changes no score of the others, so it takes records only into itself, and
a shard's expected share is its weight's. A place in the shard comes from two levels: hash buckets with
running totals, then a row number inside the bucket. There are 4,096 buckets a shard, fewer where shards are
many, so the table of totals stays within TOTALS rows as long as the shards do.

A key that many rows share is spread over its shard's buckets by the columns of `order`; rows that are equal in
both, and too many for one task, stand last in their bucket and are numbered in parts.

Edge cases: a null key is a key of its own; repeated keys share a shard and get slots of their own, in the
order of `order` and, among rows that tie in it, in any; shards with equal scores go by number; texts play no
part, whatever their length (in the query a null text has size 1 and the CRC of an empty text); an empty
table gives an empty result. The columns of df stay, whatever their names, but for shard, slot and
grown_shard, which the result's replace.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.shared import materialise, others

#: Hash buckets of a shard at most, and of all shards together (one a shard at least): the running totals that are broadcast.
BUCKETS, TOTALS = 4096, 1 << 18
#: A bucket of more rows than this, and than four times the mean, is looked through for rows that are equal in key and order: those are numbered in parts.
SPLIT = 1 << 16
#: Shards up to this many are scored by expressions side by side, which compile; more by one function over an array.
UNROLLED = 64


def _score(key: Column, shard: Column, weight: Column, seed: int) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(key.cast("string"), F.lit("\0null")), shard), 11)
    return -F.log((bits.cast("double") + 0.5) / float(1 << 53)) / weight


def shard_of(key: Column, weights: Sequence[float], seed: int = 0) -> Column:
    """The shard of a key, from 0."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive")
    if len(weights) <= UNROLLED:
        scores = F.array(*[F.struct(_score(key, F.lit(i), F.lit(float(w)), seed).alias("s"), F.lit(i).alias("i")) for i, w in enumerate(weights)])
    else:
        scores = F.transform(F.lit([float(w) for w in weights]), lambda w, i: F.struct(_score(key, i, w, seed).alias("s"), i.alias("i")))
    return F.array_min(scores)["i"]


def with_slots(rows: DataFrame, shards: int) -> DataFrame:
    """rows: _shard, _key and _order. Adds _slot: gapless from 0 in each shard, without bringing a shard, or the rows of one key and order, into one task."""
    buckets = max(1, min(BUCKETS, TOTALS // shards))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(F.lit("slot"), "_key", "_order"), F.lit(buckets)).cast("int"))
    counts = materialise(rows.groupBy("_shard", "_bucket").agg(F.count(F.lit(1)).alias("_n")))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_shard", "_bucket", "_n", before.alias("_start"))
    small = F.broadcast if shards <= TOTALS else lambda df: df
    all_, used = counts.agg(F.sum("_n"), F.count(F.lit(1))).first()
    most = max(SPLIT, 4 * (all_ or 0) // max(used, 1))
    hot = counts.where(F.col("_n") > most).select("_shard", "_bucket")
    pairs = None
    if not hot.isEmpty():
        heavy = rows.join(F.broadcast(hot), ["_shard", "_bucket"]).groupBy("_shard", "_bucket", "_key", "_order").agg(F.count(F.lit(1)).alias("_c"))
        pairs = materialise(heavy.where(F.col("_c") > most // 2))
    if pairs is None or pairs.isEmpty():
        return _ranked(rows).join(small(starts), ["_shard", "_bucket"]).withColumn("_slot", F.col("_start") + F.col("_nth") - 1)
    # There are 2 * rows / most pairs at most, so no more than TOTALS / 2 or 2 * rows / SPLIT: both sides below are sent out.
    named = pairs.select(F.col("_shard").alias("_ps"), F.col("_key").alias("_pk"), F.col("_order").alias("_po"), F.ceil(F.col("_c") / most).cast("int").alias("_parts"))
    same = (F.col("_shard") == F.col("_ps")) & F.col("_key").eqNullSafe(F.col("_pk")) & F.col("_order").eqNullSafe(F.col("_po"))
    tied = rows.join(F.broadcast(named), same).withColumn("_part", (F.monotonically_increasing_id() % F.col("_parts")).cast("int")).drop(*named.columns)
    tied = materialise(tied)  # a row's part is settled once
    cells = tied.groupBy("_shard", "_bucket", "_key", "_order", "_part").agg(F.count(F.lit(1)).alias("_m"))
    along = Window.partitionBy("_shard", "_bucket").orderBy("_key", "_order", "_part")
    reach, all_tied = F.sum("_m").over(along), F.sum("_m").over(Window.partitionBy("_shard", "_bucket"))
    cells = cells.withColumn("_before", reach - F.col("_m") - all_tied).join(small(starts), ["_shard", "_bucket"])
    cells = cells.select(*[F.col(c).alias(f"_c{c}") for c in ("_shard", "_key", "_order", "_part")], (F.col("_start") + F.col("_n") + F.col("_before")).alias("_from"))
    nth = F.row_number().over(Window.partitionBy("_shard", "_bucket", "_key", "_order", "_part").orderBy("_part"))
    same_cell = (F.col("_shard") == F.col("_c_shard")) & F.col("_key").eqNullSafe(F.col("_c_key")) & F.col("_order").eqNullSafe(F.col("_c_order")) & (F.col("_part") == F.col("_c_part"))
    tied = tied.withColumn("_nth", nth).join(F.broadcast(cells), same_cell).withColumn("_slot", F.col("_from") + F.col("_nth") - 1)
    rest = _ranked(rows.join(F.broadcast(named), same, "left_anti")).join(small(starts), ["_shard", "_bucket"])
    rest = rest.withColumn("_slot", F.col("_start") + F.col("_nth") - 1)
    return rest.select(*rows.columns, "_slot").union(tied.select(*rows.columns, "_slot"))


def _ranked(rows: DataFrame) -> DataFrame:
    """Row numbers inside a bucket."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy("_shard", "_bucket").orderBy("_key", "_order")))


def assign_shards(df: DataFrame, weights: Sequence[float], key: str = "doc_id", order: Sequence[str] = (), seed: int = 0, grow_by: float | None = None) -> DataFrame:
    """Adds shard and slot, and with grow_by (a new shard's weight) grown_shard."""
    results = ["shard", "slot"] + (["grown_shard"] if grow_by is not None else [])
    grown = [shard_of(F.col(key), [*weights, grow_by], seed).alias("_grown")] if grow_by is not None else []
    rows = df.select(F.struct(*others(df, *results)).alias("_row"), F.col(key).alias("_key"), F.struct(F.lit(0), *order).alias("_order"), shard_of(F.col(key), weights, seed).alias("_shard"), *grown)
    placed = with_slots(rows, len(weights))
    return placed.select("_row.*", F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), *([F.col("_grown").alias("grown_shard")] if grown else []))
