"""Pieces that several operators of this subpackage use."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.session import shared_dir, ship
from tidewheel.sources import files

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The two characters outside ASCII whose lower case holds an ASCII letter, and stand-ins that have none.
FOLDS_TO_ASCII, STAND_INS = "Kİ", "ĸɪ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The tables written so far, in order.
_WRITTEN: list[tuple[SparkSession, str]] = []


def _remove_all() -> None:
    while _WRITTEN:
        files.remove(*_WRITTEN.pop())


atexit.register(_remove_all)


def materialise(df: DataFrame, *partition_by: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them back, so that lost executors cost no more than this step."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/tidewheel-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    df.write.option("compression", "zstd").parquet(path, partitionBy=list(partition_by) or None)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """A mark: how many tables stand in the shared folder now."""
    return len(_WRITTEN)


def release(since: int, upto: int) -> None:
    """Removes the tables written between two marks, once no frame reads them any more."""
    gone = _WRITTEN[since:upto]
    del _WRITTEN[since:upto]
    for spark, path in gone:
        files.remove(spark, path)


def release_part(at: int, part: str) -> None:
    """Removes one partition of the table written at a mark, once no frame reads it any more."""
    spark, path = _WRITTEN[at]
    files.remove(spark, f"{path}/{part}")


def others(df: DataFrame, *results: str) -> list[str]:
    """The columns of df, quoted, that no result column replaces."""
    named = {r.lower() for r in results}
    return [f"`{c.replace('`', '``')}`" for c in df.columns if c.lower() not in named]


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else, exactly."""
    return F.translate(text, UPPER, LOWER)


def lower_for_matching(text: Column) -> Column:
    """A fast lower case in which a word has only ASCII letters and digits if and only if it had so before.

    Letters outside ASCII may change too, so it serves comparisons with ASCII words alone.
    """
    odd = F.contains(text, F.lit(FOLDS_TO_ASCII[0])) | F.contains(text, F.lit(FOLDS_TO_ASCII[1]))
    return F.lower(F.when(odd, F.translate(text, FOLDS_TO_ASCII, STAND_INS)).otherwise(text))


#: A bit table has this many bits for a key if it can, LEAST_BITS at least, and MOST_BITS in all: its broadcast takes MOST_BITS / 8 bytes.
BITS_A_KEY, LEAST_BITS, MOST_BITS = 16, 4, 1 << 29
#: Bits of a row of the table: 1,024 words.
CHUNK = 1 << 16


class KeyFilter:
    """A bit table by which rows without a match are known before any shuffle.

    keys: a written table. The table's size follows the number of keys; with more keys than it can hold
    (MOST_BITS / LEAST_BITS) there is none, every row is doubtful, and callers shuffle all rows once.
    """

    def __init__(self, keys: DataFrame, *columns: str):
        n = keys.count()
        self.bits = 0
        if 0 < n <= MOST_BITS // LEAST_BITS:
            self.bits = min(MOST_BITS, max(CHUNK, 1 << (BITS_A_KEY * n - 1).bit_length()))
            bit = F.xxhash64(*columns).bitwiseAND(F.lit(self.bits - 1))
            set_ = keys.select(bit.alias("b")).selectExpr("b >> 6 AS w", "shiftleft(1L, cast(b & 63 AS int)) AS m")
            blank = keys.sparkSession.range(self.bits >> 6).selectExpr("id AS w", "0L AS m")
            words = set_.union(blank).groupBy("w").agg(F.expr("bit_or(m)").alias("m"))
            rows = words.groupBy(F.expr("w >> 10").alias("c")).agg(F.array_sort(F.collect_list(F.struct("w", "m"))).alias("l"))
            self.table = rows.select(F.col("c").alias("_chunk"), F.col("l.m").alias("_words"))

    def flag(self, rows: DataFrame, *columns: str) -> DataFrame:
        """Adds _maybe: false only where no key equals the row's columns. rows has no column that begins so."""
        if not self.bits:
            return rows.withColumn("_maybe", F.lit(True))
        bit = F.xxhash64(*columns).bitwiseAND(F.lit(self.bits - 1))  # never null, so that no filter for nulls computes it once more
        found = rows.withColumn("_bit", bit).withColumn("_chunk", F.expr("_bit >> 16")).join(F.broadcast(self.table), "_chunk")
        hit = F.expr("bit_get(get(_words, cast((_bit >> 6) & 1023 AS int)), cast(_bit & 63 AS int)) = 1")
        return found.withColumn("_maybe", hit).drop("_bit", "_chunk", "_words")


def without(docs: DataFrame, gone: DataFrame, keys: list[Column], names: list[str]) -> DataFrame:
    """The rows of docs whose keys aren't in gone (a written table of distinct keys with the columns names); docs' columns may have any names.

    A bit table tells most rows of docs at once that they stay; only the rest is shuffled. It meets gone in an
    outer join, as Spark would push an anti-join below the bit table's join and shuffle all rows.
    """
    if gone.isEmpty():
        return docs
    named = docs.select(F.struct("*").alias("_row"), *[k.alias(f"_k{i}") for i, k in enumerate(keys)])
    own = [f"_k{i}" for i in range(len(keys))]
    gone = gone.select(*[F.col(n).alias(f"_g{i}") for i, n in enumerate(names)])
    named = KeyFilter(gone, *gone.columns).flag(named, *own)
    same = [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(own)]
    doubtful = named.where("_maybe").join(gone.withColumn("_gone", F.lit(True)), same, "left").where("_gone is null")
    return named.where("not _maybe").select("_row.*").union(doubtful.select("_row.*"))


#: Parts into which the rows of one repeated key are spread to meet it.
SPREAD = 32


def one_of_each(docs: DataFrame, repeated: DataFrame, keys: list[Column], names: list[str]) -> DataFrame:
    """The rows of docs, but any one of those that share keys which stand in repeated (a written table with the columns names).

    Copies of one key are spread over SPREAD tasks to meet repeated, and reduced to one in each task before they
    meet each other, so a key of any number of rows brings SPREAD rows into one task.
    """
    if repeated.isEmpty():
        return docs
    own = [f"_k{i}" for i in range(len(keys))]
    rows = docs.select(F.struct("*").alias("_row"), *[k.alias(o) for k, o in zip(keys, own, strict=True)], F.monotonically_increasing_id().alias("_at"))
    rows = KeyFilter(repeated, *names).flag(rows, *own)
    again = repeated.select(*[F.col(n).alias(f"_g{i}") for i, n in enumerate(names)]).distinct()
    again = again.withColumn("_gs", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    same = [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(own)]
    some = rows.where("_maybe").withColumn("_s", (F.col("_at") % SPREAD).cast("int")).join(again, [*same, F.col("_s") == F.col("_gs")], "left")
    # Rows whose keys aren't repeated stay apart by their numbers.
    some = some.withColumn("_alone", F.when(F.col("_gs").isNull(), F.col("_at")))
    reduced = some.groupBy(*own, "_alone", "_s").agg(F.any_value("_row").alias("_row")).groupBy(*own, "_alone").agg(F.any_value("_row").alias("_row"))
    return rows.where("not _maybe").select("_row.*").union(reduced.select("_row.*"))


def matching(rows: DataFrame, columns: list[str], wanted: DataFrame, names: list[str]) -> DataFrame:
    """Rows whose columns a written table of keys may hold (rows has no column that begins with an underscore)."""
    if wanted.isEmpty():
        return rows.where(F.lit(False))
    return KeyFilter(wanted, *names).flag(rows, *columns).where("_maybe").drop("_maybe")
