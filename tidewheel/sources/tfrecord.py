"""TFRecord files as rows (path, offset, record), one for each frame.

A frame is a little-endian u64 length, a u32 check sum, the bytes and another u32. Here files are the unit of
parallelism; they are read by Spark's own readers, so any store that Spark reaches will do. Offsets are the
state inside a file: a later read goes on after the last record that was seen. sources.blocks splits files.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tidewheel.session import ship

HEAD, TAIL = struct.Struct("<QI"), 4
#: Bytes of records that a batch of rows holds, about.
AT_ONCE = 1 << 24


def frames(raw: bytes, path: str = "", at: int = 0) -> Iterator[tuple[int, bytes]]:
    """(offset, record) from the frame at a byte on; a file that ends inside a frame is an error."""
    view = memoryview(raw)
    while at < len(view):
        if at + HEAD.size > len(view):
            raise ValueError(f"{path} is truncated at byte {at}")
        n, _ = HEAD.unpack_from(view, at)
        end = at + HEAD.size + n + TAIL
        if end > len(view):
            raise ValueError(f"{path} is truncated at byte {at}")
        yield at, bytes(view[at + HEAD.size : at + HEAD.size + n])
        at = end


def frame(record: bytes) -> bytes:
    """A frame without check sums (zeros), as readers here accept."""
    return HEAD.pack(len(record), 0) + record + b"\0" * TAIL


def read_tfrecords(spark: SparkSession, paths: str | list[str], after: Mapping[str, int] | None = None) -> DataFrame:
    """All records; after: for some paths, as the rows name them, the offset of the last record seen, which and all before it are left out."""
    after = dict(after or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, raw in zip(b["path"], b["content"], strict=True):
                got, held = [], 0
                for offset, record in frames(raw, path, after.get(path, 0)):
                    if offset > after.get(path, -1):
                        got.append((path, offset, record))
                        held += len(record)
                    if held > AT_ONCE:
                        yield pd.DataFrame(got, columns=["path", "offset", "record"])
                        got, held = [], 0
                yield pd.DataFrame(got, columns=["path", "offset", "record"])

    ship(spark)
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(run, "path string, offset long, record binary")


def write_tfrecords(df: DataFrame, path: str, column: str = "record") -> DataFrame:
    """Writes a binary column to a folder, one file for each partition, and gives path and records of each file.

    A file is written under its attempt's name and moved when it is whole, so a task that is run again leaves one file.
    """
    from tidewheel.sources.blocks import store

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        fs, where = store(path)
        fs.create_dir(where, recursive=True)
        name = f"{where}/part-{task.partitionId():06d}.tfrecord"
        mine, n = f"{where}/_{task.partitionId():06d}-{task.taskAttemptId()}", 0
        with fs.open_output_stream(mine) as out:
            for b in batches:
                for record in b[column]:
                    out.write(frame(bytes(record)))
                    n += 1
        fs.move(mine, name)
        yield pd.DataFrame([(name, n)], columns=["path", "records"])

    spark = df.sparkSession
    ship(spark)
    done = df.select(column).mapInPandas(run, "path string, records long").collect()  # a row for each file
    return spark.createDataFrame([tuple(r) for r in done], "path string, records long")
