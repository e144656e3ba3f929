"""Pipelines as streams: a source whose offset is the next index, and micro-batches lowered like any range."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidewheel.pipeline import MapPipeline
from tidewheel.session import ship


class _Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class _Reader(DataSourceStreamReader):
    """Options: stop (indices in all), step (indices of a micro-batch), slices (partitions of one)."""

    def __init__(self, options):
        self.stop, self.step, self.slices = int(options.get("stop", 0)), int(options.get("step", 1000)), int(options.get("slices", 4))
        self.at = 0

    def initialOffset(self) -> dict:
        return {"next_index": 0}

    def latestOffset(self) -> dict:
        self.at = min(self.at + self.step, self.stop)
        return {"next_index": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        lo, hi = start["next_index"], end["next_index"]
        self.at = max(self.at, hi)
        width = max(1, -(-(hi - lo) // self.slices))
        return [_Range(a, min(a + width, hi)) for a in range(lo, hi, width)]

    def read(self, partition: _Range) -> Iterator[tuple[int]]:
        for i in range(partition.lo, partition.hi):
            yield (i,)

    def commit(self, end: dict) -> None:
        pass


class IndexSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidewheel_index"

    def schema(self) -> str:
        return "_idx long"

    def streamReader(self, schema):
        return _Reader(self.options)


def index_stream(spark: SparkSession, stop: int, step: int = 1000) -> DataFrame:
    """A stream of the indices 0 .. stop - 1, step of them at a time."""
    ship(spark)
    # The source runs in a process that need not find this package, so its class travels whole.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    try:
        spark.dataSource.register(IndexSource)
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules[__name__])
    return spark.readStream.format("tidewheel_index").option("stop", stop).option("step", step).load()


def stream(ds: MapPipeline, stop: int, step: int, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Gives sink(df, batch number) each range of `step` elements; the checkpoint resumes after the last one."""

    def each(batch: DataFrame, number: int) -> None:
        from pyspark.sql import functions as F

        lo, hi = batch.agg(F.min("_idx"), F.max("_idx")).first()
        if lo is not None:
            sink(ds.rows(lo, hi + 1), number)

    return index_stream(ds.spark, stop, step).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
