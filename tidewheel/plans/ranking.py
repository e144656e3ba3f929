"""Dense indices without a global sort: bucket counts first, then a rank inside each bucket."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

IDX = "_idx"
#: Buckets at most, so the table of running totals that is broadcast has a fixed bound.
BUCKETS = 1 << 16
#: A bucket with more than this many times the mean share of rows (and ROWS at least) is no good base for a rank.
UNEVEN, ROWS = 64, 100_000


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    taken = {c.lower() for c in df.columns}
    mark = next(m for m in ("_tw", *(f"_tw{i}" for i in range(len(taken) + 1))) if not any(f"{m}_{n}" in taken for n in names))
    return [f"{mark}_{n}" for n in names]


def dense(df: DataFrame, order: str, span: int, size: Column | None = None, by: Sequence[str] = (), lanes: int = 1) -> DataFrame:
    """Replaces `order` (whole numbers in [0, span)) by the count of rows before; size: rows that a row stands for; by: a column of lanes, each ranked on its own, and lanes: how many there are.

    There are BUCKETS buckets of all lanes together, one a lane at least, so the totals that are broadcast have a
    bound as long as the lanes do; of more lanes than that they are joined.
    """
    b, s, t, within, start = fresh(df, "b", "s", "t", "in", "start")
    width = max(1, -(-span // max(1, BUCKETS // lanes)))
    size = F.lit(1) if size is None else size
    df = df.withColumn(b, F.floor(F.col(order) / width)).withColumn(s, size.cast("long"))
    totals = df.groupBy(*by, b).agg(F.sum(s).alias(t))
    upto = Window.partitionBy(*by).orderBy(b) if by else Window.orderBy(b)
    before = F.coalesce(F.sum(t).over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select(*by, b, before.alias(start))
    inside = F.sum(s).over(Window.partitionBy(*by, b).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(s)
    out = df.withColumn(within, inside).join(F.broadcast(starts) if lanes <= BUCKETS else starts, [*by, b])
    return out.withColumn(order, (F.col(start) + F.col(within)).cast("long")).drop(b, s, within, start)


def indexed(df: DataFrame, *order: str | Column) -> tuple[DataFrame, int]:
    """df with _idx, dense from 0 in the given total order, and its rows.

    One whole-number column, spread well enough over its range, is ranked by buckets of values: two narrow
    looks at the key, nothing written. Other orders take a range repartition, written once, because its
    bounds come from a sample, and offsets of the partitions.
    """
    columns = [F.col(o) if isinstance(o, str) else o for o in order]
    if len(columns) == 1:
        sorted_by = re.fullmatch(r"Column<'(.+) (ASC|DESC) NULLS (?:FIRST|LAST)'>", str(columns[0]))
        key, falling = (F.expr(sorted_by[1]), sorted_by[2] == "DESC") if sorted_by else (columns[0], False)
        if isinstance(df.select(key).schema[0].dataType, T.IntegralType):
            low, high, n, nulls = df.agg(F.min(key), F.max(key), F.count(F.lit(1)), F.count_if(key.isNull())).first()
            if n and not nulls:
                span = int(high) - int(low) + 1
                place = (F.lit(int(high)) - key if falling else key - F.lit(int(low))).cast("long")
                width = max(1, -(-span // BUCKETS))
                most = df.groupBy(F.floor(place / width).alias("b")).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c"), F.count(F.lit(1))).first()
                if span < 1 << 53 and most[0] <= max(ROWS, UNEVEN * n // most[1]):
                    return dense(df.withColumn(IDX, place), IDX, span), n
    out = _by_partitions(df, columns)
    return out, out.count()


def with_index(df: DataFrame, *order: str | Column) -> DataFrame:
    """Adds _idx, dense from 0 in the given total order."""
    return indexed(df, *order)[0]


def _by_partitions(df: DataFrame, columns: list[Column]) -> DataFrame:
    from tidewheel.sources.tables import stash

    parts = stash(df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("_tw_p", F.spark_partition_id()).withColumn("_tw_m", F.monotonically_increasing_id()))
    counts = parts.groupBy("_tw_p").agg(F.count(F.lit(1)).alias("_tw_n"), F.min("_tw_m").alias("_tw_first"))  # one row for each partition
    before = F.coalesce(F.sum("_tw_n").over(Window.orderBy("_tw_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_tw_p", (before - F.col("_tw_first")).alias("_tw_shift"))
    return parts.join(F.broadcast(starts), "_tw_p").withColumn(IDX, F.col("_tw_m") + F.col("_tw_shift")).drop("_tw_p", "_tw_m", "_tw_shift")
