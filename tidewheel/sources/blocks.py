"""Files as blocks of rows: record files by byte ranges, Parquet files by row groups.

A plan of blocks, made once from the frames' lengths or the footers, tells for each block its file, its place
there and the number of its first row among all rows. So rows have a dense index without a ranking, a long file
is read by many tasks, and a slice, a shard or a state (a row's number) opens only the blocks that it touches.
Files follow one another in the order of their paths.

Blocks are opened on the executors through Arrow's file systems (local and mounted folders, hdfs, s3, gs, abfs);
other schemes raise at once, and read_tfrecords or iterate_parquet, which use Spark's readers, serve them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from urllib.parse import quote, urlsplit

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewheel.pipeline import MapPipeline, _epochs
from tidewheel.plans.ranking import IDX
from tidewheel.session import ship
from tidewheel.sources.tables import stash
from tidewheel.sources.tfrecord import HEAD, TAIL

#: Bytes of a block of records, about.
BLOCK = 1 << 24
#: Bytes read at a time while frames are counted, and rows of a batch.
AHEAD, ROWS = 1 << 20, 1 << 14
#: Tasks at most for one read.
TASKS = 100_000
#: Hadoop's names of schemes that Arrow names otherwise.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}


def store(path: str) -> tuple[stores.FileSystem, str]:
    """The file system and the path there."""
    scheme = urlsplit(path).scheme
    if scheme in ("", "file"):
        return stores.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return stores.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + quote(path[len(scheme) :], safe=":/@"))


def _listed(spark: SparkSession, paths: str | Sequence[str]) -> tuple[DataFrame, int]:
    """path and bytes of each file, one task each up to a bound; contents aren't read."""
    ship(spark)
    if not paths:
        raise ValueError("no path is given")
    files = spark.read.format("binaryFile").load([paths] if isinstance(paths, str) else list(paths)).select("path", F.col("length").alias("bytes"))
    n, first = files.agg(F.count(F.lit(1)), F.min("path")).first()
    if first is not None:
        store(first)
    return files.repartition(max(1, min(n, TASKS))), n


def _numbered(blocks: DataFrame) -> DataFrame:
    """Adds first: the rows of all blocks before, by file and inside a file."""
    inside = F.sum("rows").over(Window.partitionBy("path").orderBy("at")) - F.col("rows")
    files = blocks.groupBy("path").agg(F.sum("rows").alias("_all"))
    before = files.select("path", (F.sum("_all").over(Window.orderBy("path")) - F.col("_all")).alias("_before"))
    return blocks.withColumn("first", inside).join(before, "path").withColumn("first", F.col("first") + F.col("_before")).drop("_before")


def index_records(spark: SparkSession, paths: str | Sequence[str], block: int = BLOCK) -> DataFrame:
    """The blocks of record files: path, bytes (of the file), at, upto (byte range), rows, first. Write it to keep it; each file is walked by one task, its payloads skipped."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, size in zip(b["path"], b["bytes"], strict=True):
                out = [(path, size, *found) for found in record_blocks(path, int(size), block)]
                yield pd.DataFrame(out, columns=["path", "bytes", "at", "upto", "rows"])

    files, _ = _listed(spark, paths)
    return _numbered(stash(files.mapInPandas(walk, "path string, bytes long, at long, upto long, rows long")))


def record_blocks(path: str, size: int, block: int = BLOCK) -> Iterator[tuple[int, int, int]]:
    """(first byte, byte after the last, records) of blocks of a file; a file that ends inside a frame is an error."""
    fs, where = store(path)
    with fs.open_input_file(where) as f:
        at, begin, rows, base, held = 0, 0, 0, 0, b""
        while at < size:
            if at + HEAD.size > base + len(held):
                f.seek(at)
                base, held = at, f.read(AHEAD)
            if at + HEAD.size > size:
                raise ValueError(f"{path} is truncated at byte {at}")
            end = at + HEAD.size + HEAD.unpack_from(held, at - base)[0] + TAIL
            if end > size:
                raise ValueError(f"{path} is truncated at byte {at}")
            at, rows = end, rows + 1
            if at - begin >= block:
                yield begin, at, rows
                begin, rows = at, 0
        if rows:
            yield begin, at, rows


def _records(path: str, at: int, upto: int, first: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """The records of a block whose numbers are in [low, high), AHEAD bytes or a record at a time."""
    fs, where = store(path)
    with fs.open_input_file(where) as f:
        f.seek(at)
        number, got, held = first, [], 0
        while at < upto and number < high:
            n = HEAD.unpack(f.read(HEAD.size))[0]
            if number >= low:
                got.append((number, path, at, f.read(n)))
                held += n
                f.seek(TAIL, 1)
            else:
                f.seek(n + TAIL, 1)
            at, number = at + HEAD.size + n + TAIL, number + 1
            if held > AHEAD or len(got) == ROWS or at >= upto or number >= high:
                columns = list(zip(*got, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.binary()), strict=True)], names=[IDX, "path", "offset", "record"])
                got, held = [], 0


def records(spark: SparkSession, paths: str | Sequence[str], index: DataFrame | None = None, block: int = BLOCK) -> MapPipeline:
    """Record files by random access: path, offset, record. index: as index_records gave it, of the same files as they are now."""
    if index is None:
        blocks = index_records(spark, paths, block)
    else:
        files, _ = _listed(spark, paths)
        known = index.select("path", F.col("bytes").alias("_known")).distinct()
        if not files.where("bytes > 0").join(known, "path", "full").where("not bytes <=> _known").isEmpty():
            raise ValueError("the index is of other files")
        blocks = index
    return _Blocks(blocks, _records, "path string, offset long, record binary")


def index_row_groups(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """The row groups of Parquet files, by their footers: path, bytes (of the file), at (its number), upto, rows, first."""

    def footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, size in zip(b["path"], b["bytes"], strict=True):
                fs, where = store(path)
                with fs.open_input_file(where) as f:
                    footer = pq.read_metadata(f)
                out = [(path, size, g, g + 1, footer.row_group(g).num_rows) for g in range(footer.num_row_groups)]
                yield pd.DataFrame(out, columns=["path", "bytes", "at", "upto", "rows"])

    files, _ = _listed(spark, paths)
    return _numbered(stash(files.mapInPandas(footers, "path string, bytes long, at long, upto long, rows long").where("rows > 0")))


def row_groups(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None) -> MapPipeline:
    """Parquet files in stored order by random access: a range of rows opens its row groups only, and only the columns asked for."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    schema = T.StructType([df.schema[c] for c in columns]) if columns is not None else df.schema
    names, target = schema.names, to_arrow_schema(T.StructType([T.StructField(IDX, T.LongType()), *schema]))

    def read(path: str, at: int, upto: int, first: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
        fs, where = store(path)
        with fs.open_input_file(where) as f:
            for b in pq.ParquetFile(f).iter_batches(ROWS, [at], columns=names):
                lo, hi = max(low - first, 0), min(high - first, b.num_rows)
                if lo < hi:
                    part = pa.Table.from_batches([b.slice(lo, hi - lo)]).select(names)
                    numbers = pa.array(range(first + lo, first + hi), pa.int64())
                    yield from part.add_column(0, IDX, numbers).cast(target).to_batches()
                first += b.num_rows
                if first >= high:
                    return

    return _Blocks(index_row_groups(spark, paths), read, schema)


class _Blocks(MapPipeline):
    """Rows of a plan of blocks; read(path, at, upto, first, low, high) gives Arrow batches with _idx."""

    def __init__(self, blocks: DataFrame, read: Callable, schema: str | T.StructType):
        self.schema = blocks.sparkSession.createDataFrame([], schema).schema
        self._make, self._df = read, blocks
        n, self.blocks, self.digest = blocks.agg(F.sum("rows"), F.count(F.lit(1)), F.expr("bit_xor(xxhash64(path, bytes, at, rows))")).first()
        self.n = n or 0

    @property
    def spark(self):
        return self._df.sparkSession

    def signature(self) -> str:
        return f"blocks:{self.schema.simpleString()}:{self.n}:{self.blocks}:{self.digest}"

    def rows(self, lo, hi):
        n = self.n
        whole = n == 0 or hi <= lo or lo // n != (hi - 1) // n
        epoch = 0 if whole else lo // n
        low, high = (0, n if hi > lo else 0) if whole else (lo - epoch * n, hi - epoch * n)
        read = self._make

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    yield from read(r["path"], r["at"], r["upto"], r["first"], low, high)

        wanted = self._df.where((F.col("first") < high) & (F.col("first") + F.col("rows") > low)).select("path", "at", "upto", "first")
        tasks = max(1, min(TASKS, 2 + self.blocks * (high - low) // max(n, 1)))
        out = wanted.repartition(tasks).mapInArrow(run, T.StructType([T.StructField(IDX, T.LongType()), *self.schema]))
        return _epochs(out, n, lo, hi) if whole else out.withColumn(IDX, F.col(IDX) + epoch * n)
