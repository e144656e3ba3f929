"""Tables as sources, and a place for intermediate results."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.functions.schedules import Shard
from tidewheel.plans.ranking import IDX, fresh
from tidewheel.session import shared_dir
from tidewheel.sources import files

if TYPE_CHECKING:
    from tidewheel.pipeline import IterPipeline


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes when the interpreter ends."""
    path = f"{shared_dir(spark)}/tidewheel-{uuid.uuid4().hex}"
    atexit.register(files.remove, spark, path)
    return path


def stash(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read back: lineage ends here. The files go when the interpreter ends."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def iterate_parquet(spark: SparkSession, paths: str | Sequence[str], cycle_length: int = 16, shard: Shard = Shard(), **options: str) -> IterPipeline:
    """Rows of Parquet files: one path in its stored order, several interleaved, cycle_length of them open at a time.

    A folder or a pattern is one path: its files follow one another in the order of their paths. A shard takes every
    shard.count-th path, so files of others are never opened. options: the reader's.
    """
    from tidewheel.pipeline import IterPipeline

    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("no path is given")
    own = [IterPipeline.source(df) for df in parquet_in_file_order(spark, paths[shard.index :: shard.count], **options)]
    if not own:
        raise ValueError("a shard has no file")
    return own[0] if len(own) == 1 else IterPipeline.interleave(own, cycle_length)


def parquet_in_file_order(spark: SparkSession, paths: str | Sequence[str], **options: str) -> list[DataFrame]:
    """One DataFrame for each path, with _idx as the rows' stored order."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("no path is given")
    return [_stored(spark.read.options(**options).parquet(p)) for p in paths]


def _stored(df: DataFrame) -> DataFrame:
    """Adds _idx: the row's place in its file, after the rows of all files before it."""
    columns, place = [F.col(f"`{c.replace('`', '``')}`") for c in df.columns], F.col("_metadata.row_index")
    if len(df.inputFiles()) < 2:
        return df.select(*columns, place.alias(IDX))
    path, n, before = fresh(df, "path", "n", "before")
    files = df.groupBy(F.col("_metadata.file_path").alias(path)).agg(F.count(F.lit(1)).alias(n))  # no column is read for it
    files = files.select(path, (F.sum(n).over(Window.orderBy(path)) - F.col(n)).alias(before))
    rows = df.select(*columns, place.alias(IDX), F.col("_metadata.file_path").alias(path))
    return rows.join(F.broadcast(files), path).withColumn(IDX, F.col(IDX) + F.col(before)).drop(path, before)


def in_memory(spark: SparkSession, elements: Sequence, name: str | None = None) -> DataFrame:
    """Plain values (numbers, booleans, strings, bytes, None) as (value, _idx), cached; name: also a temporary view."""
    if any(not isinstance(x, (int, float, bool, str, bytes, type(None))) for x in elements):
        raise TypeError("only plain values can be shared")
    kinds = {type(x) for x in elements if x is not None}
    if len(kinds) > 1:
        raise TypeError("values must be of one type")
    sql = {int: "bigint", float: "double", bool: "boolean", str: "string", bytes: "binary"}[kinds.pop() if kinds else str]
    df = spark.createDataFrame([(x, i) for i, x in enumerate(elements)], f"value {sql}, _idx bigint").cache()
    if name:
        df.createOrReplaceTempView(name)
    return df


def attach(spark: SparkSession, name: str) -> DataFrame:
    """The in-memory elements that were shared under a name."""
    return spark.table(name)
