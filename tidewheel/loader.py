"""Samplers and a loader: which records to read, in which order, on which shard, with how many workers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.cursor import Cursor
from tidewheel.functions.schedules import Shard, even_split
from tidewheel.operators.transforms import Batch, apply_all
from tidewheel.pipeline import IterPipeline, _div, elastic_batches, permuted, told  # noqa: F401


class SequentialSampler:
    """index == key; drop_remainder keeps a multiple of the shard count."""

    def __init__(self, num_records: int, shard: Shard = Shard(), seed: int | None = None):
        if num_records <= 0:
            raise ValueError("num_records must be positive")
        self.num_records, self.shard, self.seed = num_records, shard, seed

    def __len__(self) -> int:
        c = self.shard.count
        return self.num_records // c * c if self.shard.drop_remainder else self.num_records

    def keys(self, spark: SparkSession, lo: int, hi: int, step: int = 1) -> DataFrame:
        """_index and _record_key of indices lo, lo + step, ... below hi."""
        if lo < 0 or hi > len(self):
            raise IndexError("an index is out of range")
        return spark.range(lo, hi, step).select(F.col("id").alias("_index"), F.col("id").alias("_record_key"))

    def __repr__(self) -> str:
        return f"{type(self).__name__}({self.num_records}, {self.shard}, seed={self.seed})"


class IndexSampler:
    """Keys of a contiguous shard, repeated by epoch, each epoch shuffled with a seed of its own."""

    def __init__(self, num_records: int, shard: Shard = Shard(), shuffle: bool = False, num_epochs: int | None = None, seed: int | None = None):
        if num_records <= 0:
            raise ValueError("num_records must be positive")
        if num_epochs is not None and num_epochs <= 0:
            raise ValueError("num_epochs must be positive")
        if shuffle and seed is None:
            raise ValueError("a shuffle needs a seed")
        if seed is not None and not 0 <= seed < 1 << 32:
            raise ValueError("seed must be in [0, 2**32)")
        self.num_records, self.shard, self.shuffle, self.num_epochs, self.seed = num_records, shard, shuffle, num_epochs, seed
        self.start, self.end = even_split(num_records, shard)

    def __len__(self) -> int:
        if self.num_epochs is None:
            return (1 << 63) - 1
        total = self.num_records * self.num_epochs
        return min(total, (self.end - self.start) * self.shard.count * self.num_epochs) if self.shard.drop_remainder else total

    def keys(self, spark: SparkSession, lo: int, hi: int, step: int = 1) -> DataFrame:
        if lo < 0 or hi > len(self):
            raise IndexError("an index is out of range")
        m = self.end - self.start
        j = _div(F.col("id"), self.shard.count)
        epoch, place = _div(j, m), F.pmod(j, F.lit(m))
        if self.shuffle:
            place = permuted(place, m, F.pmod(F.lit(self.seed).cast("long") + epoch, F.lit(1 << 32)), inverse=False)
        return spark.range(lo, hi, step).select(F.col("id").alias("_index"), F.pmod(F.lit(self.start) + place, F.lit(self.num_records)).alias("_record_key"))

    def __repr__(self) -> str:
        return f"{type(self).__name__}({self.num_records}, {self.shard}, shuffle={self.shuffle}, num_epochs={self.num_epochs}, seed={self.seed})"


class CustomSampler:
    """A sampler of the user's: sampler[index] has record_key (or is the key) and raises IndexError past the end.

    Keys are made on the executors, in blocks of indices. Without __len__ the length is found by doubling an index
    until it is past the end, and halving the gap. seed: for random maps, which draw by record.
    """

    def __init__(self, sampler: object, shard: Shard = Shard(), seed: int | None = None):
        self.sampler, self.shard, self.seed = sampler, shard, seed
        self._length = len(sampler) if hasattr(sampler, "__len__") else self._found()

    def _has(self, index: int) -> bool:
        try:
            self.sampler[index]
        except IndexError:
            return False
        return True

    def _found(self) -> int:
        if not self._has(0):
            return 0
        low, high = 0, 1
        while high < 1 << 62 and self._has(high):
            low, high = high, 2 * high
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if self._has(mid) else (low, mid)
        return high

    def __len__(self) -> int:
        return self._length

    def keys(self, spark: SparkSession, lo: int, hi: int, step: int = 1) -> DataFrame:
        if lo < 0 or hi > len(self):
            raise IndexError("an index is out of range")
        sampler = self.sampler

        def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                found = [sampler[i] for i in b["_index"].tolist()]
                yield b.assign(_record_key=[getattr(x, "record_key", x) for x in found])

        return spark.range(lo, hi, step).withColumnRenamed("id", "_index").mapInPandas(made, "_index long, _record_key long")

    def __repr__(self) -> str:
        return f"CustomSampler({told(self.sampler)}, {self.shard}, seed={self.seed})"


@dataclass
class DataLoader:
    """source: rows with _idx. The sampler's indices of this shard, looked up, then the operations.

    With worker_count > 1 each worker takes a strided part and forms its own batches; workers' results are
    taken in turn. Random maps draw by record: the generator's key is the sampler's seed plus the index.
    """

    source: DataFrame
    sampler: SequentialSampler | IndexSampler | CustomSampler
    operations: Sequence = ()
    worker_count: int = 0
    shard: Shard | None = None

    def __post_init__(self):
        if self.worker_count < 0:
            raise ValueError("worker_count must not be negative")
        self.shard = self.shard or self.sampler.shard

    def records(self) -> IterPipeline:
        n = len(self.sampler)
        if n >= (1 << 62):
            raise ValueError("an endless sampler needs num_epochs")
        s = self.shard
        hi = n // s.count * s.count if s.drop_remainder else n
        spark = self.source.sparkSession
        keys = self.sampler.keys(spark, s.index, hi, s.count).withColumn("_at", _div(F.col("_index"), s.count))
        df = self.source.withColumnRenamed("_idx", "_k").join(keys, F.col("_k") == F.col("_record_key")).drop("_k", "_record_key")
        records = IterPipeline._own_source(df.withColumnsRenamed({"_at": "_idx", "_index": "_record"}))
        records._context = (0, 1, self.sampler.seed)
        records._knowing(lambda: [len(range(s.index, hi, s.count))])
        return records

    def pipeline(self) -> IterPipeline:
        if self.worker_count <= 1:
            return apply_all(self.records(), list(self.operations))
        return self.records().parallel(self.worker_count, lambda part: apply_all(part, list(self.operations)))

    def __iter__(self) -> Cursor:
        return Cursor(self.pipeline(), extra={"sampler": repr(self.sampler), "workers": self.worker_count})


def load(source: DataFrame, n: int, *, num_epochs: int | None = None, shuffle: bool = False, seed: int | None = None, shard: Shard = Shard(), transformations: Sequence = (), batch_size: int | None = None, drop_remainder: bool = False, worker_count: int = 0) -> DataLoader:
    """A loader over an index sampler."""
    operations = [*transformations, *([Batch(batch_size, drop_remainder)] if batch_size else [])]
    return DataLoader(source, IndexSampler(n, shard, shuffle, num_epochs, seed), operations, worker_count)
