"""Sequence packing in two phases.

Phase one assigns elements to rows from their lengths alone. First fit and best fit depend on every element
before, but only as far back as the open batch: when no bin has room all bins are given out, so a batch is a
function of its first element. Elements are cut into blocks of BLOCK by their index, and every block assumes that
a batch begins at its first element; it notes where its batches begin and where the last one, which may reach
into the next block, ends. Two runs that begin a batch at the same element are one from there on, so most blocks
end at the same place whatever comes before. Then each block starts where the one before it ended, runs until it
meets a start that it has noted, and only blocks whose predecessor ended elsewhere than assumed run again, until
none is left. Rows before a block are sums over blocks. At last all blocks place their elements side by side.
With workers=n the n strided parts are sequences of their own, as n loading processes would make them.

Concatenating and cutting one feature is no sequential matter: prefix sums say where each element stands.
Phase two joins the payload to its places and builds the rows in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import chain, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.bins import BinPacker, cut_stream
from tidewheel.operators.batching import blocks, field, quoted
from tidewheel.plans.ranking import dense
from tidewheel.session import ship
from tidewheel.sources.tables import stash

IDX = "_idx"
SCHEMA = f"{IDX} long, row long, segment int, at array<long>, since array<long>, size array<long>"


PLACED = pa.schema({IDX: pa.int64(), "row": pa.int64(), "segment": pa.int32(), "at": pa.list_(pa.int64()), "since": pa.list_(pa.int64()), "size": pa.list_(pa.int64())})


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, 10_000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), PLACED.types, strict=True)], schema=PLACED)


#: Elements of a block, and what it sees of the next one to end its last batch. Longer batches make blocks larger.
BLOCK, AHEAD = 1 << 17, 4


class _TooLong(Exception):
    """A batch reaches past what its block sees."""


def assign_bins(lengths: DataFrame, capacity: Sequence[int], bins: int, best: bool = False, workers: int = 1, block: int | None = None, start: tuple[int, int] = (0, 0), borders: Callable[[DataFrame], None] | None = None, **options) -> DataFrame:
    """lengths: _idx, len (array, one for each feature) and maybe values (array of numbers, see BinPacker). Gives _idx, row, segment, at, since, size.

    start: an element that begins a batch, before which lengths hold nothing, and the rows before it (for one worker).
    borders: is given a frame of such starts, element and row, one about every `block` elements.
    """
    ship(lengths.sparkSession)
    BinPacker(capacity, bins, best, **options)  # checks the arguments
    if workers > 1 and start != (0, 0):
        raise ValueError("the parts of several workers have no common start")
    parts = lengths.withColumn("_w", F.pmod(F.col(IDX), F.lit(workers)).cast("long")).withColumn("_at", F.expr(f"({IDX} - {start[0]}) div {workers}"))
    block = block or BLOCK
    while True:
        try:
            placed, begun = _by_blocks(parts, block, lambda emitted=0: BinPacker(capacity, bins, best, emitted=start[1] + emitted, **options), "values" in lengths.columns)
            if borders is not None:
                borders(begun.select((F.col("_start") + start[0]).alias("element"), (F.col("_emitted") + start[1]).alias("row")))
            break
        except _TooLong:
            block *= 8
    if workers == 1:
        return placed.drop("_w")
    # Rows of the parts are taken in turn: ended parts are passed over.
    counts = placed.groupBy("_w").agg((F.max("row") + 1).alias("_c"))
    order = counts.groupBy().agg(F.collect_list(F.struct("_w", "_c")).alias("_all"))  # as many as workers
    ranked = placed.join(F.broadcast(order), F.lit(True))
    before = F.aggregate("_all", F.lit(0).cast("long"), lambda s, x: s + F.least(x["_c"], F.col("row") + F.when(x["_w"] < F.col("_w"), 1).otherwise(0)))
    return ranked.withColumn("row", before).drop("_all", "_w")


def _by_blocks(parts: DataFrame, block: int, packer, valued: bool) -> tuple[DataFrame, DataFrame]:
    """The places, and where each block begins. parts: _w (a sequence), _at (place in it), _idx, len and maybe values."""
    ahead = max(1, block // AHEAD)
    number = F.expr(f"_at div {block}")
    seen = F.when((number > 0) & (F.pmod("_at", F.lit(block)) < ahead), F.array(number, number - 1)).otherwise(F.array(number))
    columns = ["_w", "_b", "_at", IDX, "len", *(["values"] if valued else [])]
    ends = stash(parts.groupBy("_w").agg((F.max("_at") + 1).alias("_n")))  # one row a sequence
    elements = stash(parts.withColumn("_b", F.explode(seen)).select(*columns))

    def placed(rows: pa.Table, told: pa.Table) -> pa.Table:
        rows, t = rows.sort_by("_at"), {k: v[0] for k, v in told.to_pydict().items()}
        lo, n = rows.column("_at")[0].as_py() if len(rows) else 0, max(0, t["_end"] - t["_start"])
        own = rows.slice(t["_start"] - lo, n) if n else rows.slice(0, 0)
        pack = packer(t["_emitted"])
        got = (x for e in zip(*(own.column(c).to_pylist() for c in columns[3:]), strict=True) for x in pack.place(*e))
        out = pa.Table.from_batches(list(_batches((i, row, segment, at, [0] * len(at), size) for i, row, segment, at, size in chain(got, pack.flush()))), schema=PLACED)
        return out.append_column("_w", pa.array([t["_w"]] * len(out), pa.int64()))

    def place(begun: DataFrame) -> tuple[DataFrame, DataFrame]:
        """begun: where each block's first batch begins, where its last one ends, and the rows before."""
        return elements.groupBy("_w", "_b").cogroup(begun.groupBy("_w", "_b")).applyInArrow(placed, SCHEMA + ", _w long"), begun

    if (ends.agg(F.max("_n")).first()[0] or 0) <= block:
        return place(ends.select("_w", F.lit(0).cast("long").alias("_b"), F.lit(0).cast("long").alias("_start"), F.col("_n").alias("_end"), F.lit(0).cast("long").alias("_emitted")))

    def opened(rows: pa.Table) -> tuple[list, int, int]:
        """The block's elements in order, where it begins and where it ends."""
        rows = rows.sort_by("_at")
        lo = rows.column("_b")[0].as_py() * block
        return list(zip(rows.column("_at").to_pylist(), rows.column("len").to_pylist(), strict=True)), lo, lo + block

    def runs(elements: list, start: int, lo: int, hi: int, known: dict[int, int] | None) -> tuple[int, int, list[int], list[int]]:
        """From a batch's start: where the first batch beyond the block begins (-1: not seen; -2: at a start that is known), rows on the way, and the starts with the rows before each."""
        starts, rows, total, at = [start], [0], 0, start
        for at, of_batch in packer().batch_starts(elements[start - lo :]):
            total += of_batch
            if at >= hi:
                return at, total, starts, rows
            if known is not None and at in known:
                return -2, total, [*starts, at], rows
            starts.append(at)
            rows.append(total)
        return -1, total, starts, rows

    def assumed(rows: pa.Table) -> pa.Table:
        elements, lo, hi = opened(rows)
        end, total, starts, before = runs(elements, lo, lo, hi, None)
        return pa.table({"_w": rows["_w"][:1], "_b": rows["_b"][:1], "_end": [end], "_rows": [total], "_starts": [starts], "_before": [before], "_last": [elements[-1][0] + 1]})

    noted = stash(elements.groupBy("_w", "_b").applyInArrow(assumed, "_w long, _b long, _end long, _rows long, _starts array<long>, _before array<long>, _last long"))
    # A batch whose end isn't seen ends with its sequence, or else the block is too small.
    noted = noted.join(F.broadcast(ends), "_w")
    if not noted.where("_end = -1 and _last < _n").isEmpty():
        raise _TooLong
    noted = noted.withColumn("_end", F.when(F.col("_end") < 0, F.col("_n")).otherwise(F.col("_end"))).drop("_last")

    def corrected(rows: pa.Table, told: pa.Table) -> pa.Table:
        """A block's end and rows from its true start on; it runs until it meets what it has noted."""
        if not len(told):
            return pa.table({k: pa.array([], pa.int64()) for k in ("_w", "_b", "_start", "_end", "_rows")})
        t = {k: v[0] for k, v in told.to_pydict().items()}
        lo = t["_b"] * block
        known = dict(zip(t["_starts"], t["_before"], strict=True))
        if t["_start"] >= lo + block or t["_start"] >= t["_n"]:  # the batch before covers the whole block
            end, total = t["_start"], 0
        elif t["_start"] in known:
            end, total = t["_end"], t["_rows"] - known[t["_start"]]
        else:
            elements, lo, hi = opened(rows)
            end, total, starts, _ = runs(elements, t["_start"], lo, hi, known)
            if end == -2:
                end, total = t["_end"], total + t["_rows"] - known[starts[-1]]
            elif end == -1:
                end = t["_n"] if elements[-1][0] + 1 >= t["_n"] else -1
        return pa.table({"_w": [t["_w"]], "_b": [t["_b"]], "_start": [t["_start"]], "_end": [end], "_rows": [total]})

    def again(wanted: DataFrame) -> DataFrame:
        """wanted: _w, _b, _start."""
        told = noted.join(wanted, ["_w", "_b"])
        return elements.groupBy("_w", "_b").cogroup(told.groupBy("_w", "_b")).applyInArrow(corrected, "_w long, _b long, _start long, _end long, _rows long")

    def after(found: DataFrame) -> DataFrame:
        """Where the next blocks begin."""
        return found.select("_w", (F.col("_b") + 1).alias("_b"), F.col("_end").alias("_start"))

    first = noted.where("_b = 0").select("_w", "_b", F.lit(0).cast("long").alias("_start"))
    found = stash(again(first.unionByName(after(noted))))
    while True:
        if not found.where("_end = -1").isEmpty():
            raise _TooLong
        want = after(found).withColumnRenamed("_start", "_want").join(found.select("_w", "_b", "_start"), ["_w", "_b"]).where("_want <> _start")
        wrong = stash(want.select("_w", "_b", F.col("_want").alias("_start")))
        if wrong.isEmpty():
            break
        kept = found.join(wrong.select("_w", "_b"), ["_w", "_b"], "left_anti")
        found = stash(kept.unionByName(again(wrong)))
    before = F.sum("_rows").over(Window.partitionBy("_w").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    return place(found.withColumn("_emitted", F.coalesce(before, F.lit(0))))  # a row for each block


def assign_cuts(lengths: DataFrame, target: Sequence[int], split_full: bool = True, workers: int = 1) -> DataFrame:
    """As assign_bins, for a concatenated stream that is cut where a feature is full."""

    def place(elements: Iterator[tuple]) -> Iterator[tuple]:
        yield from cut_stream(((i, n) for i, n, *_ in elements), target, split_full)

    return _assigned(lengths, place, workers)


def _assigned(lengths: DataFrame, place, workers: int) -> DataFrame:
    ship(lengths.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(place(x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True)))

    if workers == 1:
        return lengths.repartition(1).sortWithinPartitions(IDX).mapInArrow(run, SCHEMA)

    def part(table: pa.Table) -> pa.Table:
        own = table.sort_by(IDX)
        w = own.column("_w")[0].as_py()
        out = pa.Table.from_batches(list(_batches(place(zip(*(own.column(c).to_pylist() for c in own.column_names if c != "_w"), strict=True)))))
        return out.append_column("_w", pa.array([w] * out.num_rows, pa.int64()))

    parts = lengths.withColumn("_w", F.pmod(F.col(IDX), F.lit(workers)).cast("long")).groupBy("_w").applyInArrow(part, SCHEMA + ", _w long")
    # Rows of the parts are taken in turn: ended parts are passed over.
    counts = parts.groupBy("_w").agg((F.max("row") + 1).alias("_c"))
    order = counts.groupBy().agg(F.collect_list(F.struct("_w", "_c")).alias("_all"))  # as many as workers
    ranked = parts.join(F.broadcast(order), F.lit(True))
    before = F.aggregate("_all", F.lit(0).cast("long"), lambda s, x: s + F.least(x["_c"], F.col("row") + F.when(x["_w"] < F.col("_w"), 1).otherwise(0)))
    return ranked.withColumn("row", before).drop("_all", "_w")


def assign_prefix_sums(lengths: DataFrame, target: int, span: int) -> DataFrame:
    """assign_cuts for one feature without its task: all prefix sums, in parallel."""
    sized = lengths.select(IDX, F.get("len", F.lit(0)).alias("_n"))
    sums = dense(sized.withColumn("_order", F.col(IDX)), "_order", span, F.col("_n")).where("_n > 0")
    first, last = F.call_function("div", F.col("_order"), F.lit(target).cast("long")), F.call_function("div", F.col("_order") + F.col("_n") - 1, F.lit(target).cast("long"))
    pieces = sums.withColumn("row", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("_order"), F.col("row") * target)
    hi = F.least(F.col("_order") + F.col("_n"), (F.col("row") + 1) * target)
    segment = F.row_number().over(Window.partitionBy("row").orderBy(IDX))  # a row has at most `target` pieces
    return pieces.select(IDX, "row", segment.alias("segment"), F.array(lo - F.col("row") * target).alias("at"), F.array(lo - F.col("_order")).alias("since"), F.array(hi - lo).alias("size"))


def materialise_rows(df: DataFrame, places: DataFrame, features: Mapping[str, int], meta: Sequence[str] = (), pad: Mapping[str, object] | None = None, bos: Mapping[str, object] | None = None, drop_ids: Sequence[str] = ()) -> DataFrame:
    """The packed rows: each feature padded to its length, with _segment_ids (from 1) and _positions; meta columns as arrays by segment."""
    kinds = dict(df.dtypes)
    # Features and meta columns go by number, as they may be called like a place's columns.
    payload = [F.col(quoted(f)).alias(f"_f{i}") for i, f in enumerate(features)] + [F.col(quoted(m)).alias(f"_m{i}") for i, m in enumerate(meta)]
    joined = df.select(IDX, *payload).join(places, IDX)
    own = [F.slice(f"_f{i}", (F.get("since", F.lit(i)) + 1).cast("int"), F.get("size", F.lit(i)).cast("int")).alias(f"_f{i}") for i, _ in enumerate(features)]
    cell = F.struct("segment", *own, "at", *[f"_m{i}" for i, _ in enumerate(meta)]).alias("_cell")
    rows = joined.select("row", cell).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("_cell.segment", "_cell"))).alias("_cells"))
    rows = rows.withColumn("_cells", F.transform("_cells", lambda c: c["_cell"]))
    out = []
    for i, (f, size) in enumerate(features.items()):
        element = kinds[f].removeprefix("array<")[:-1]
        fill = _filler(df, f, element, (pad or {}).get(f, 0))

        def laid(part, filler, i=i, size=size):
            """Pieces with their gaps (alignment) before them, then padding."""
            n = lambda c: F.size(c[f_])
            f_ = f"_f{i}"
            ends = lambda k: F.when(k == 0, F.lit(0)).otherwise((F.get(F.get(F.col("_cells"), k - 1)["at"], F.lit(i)) + F.size(F.get(F.col("_cells"), k - 1)[f_])).cast("int"))
            pieces = F.flatten(F.transform("_cells", lambda c, k: F.concat(F.array_repeat(filler, (F.get(c["at"], F.lit(i)).cast("int") - ends(k)).cast("int")), part(c, n(c)))))
            return F.concat(pieces, F.array_repeat(filler, F.lit(size) - F.size(pieces)))

        first = (bos or {}).get(f)
        values = (lambda c, n, f=f"_f{i}": c[f]) if first is None else (lambda c, n, f=f"_f{i}", first=first, element=element: F.when(n > 0, F.concat(F.array(F.lit(first).cast(element)), F.slice(c[f], 2, F.greatest(n - 1, F.lit(0))))).otherwise(c[f]))
        out.append(laid(values, fill).alias(f))
        if f not in drop_ids:
            zero = F.lit(0).cast("int")
            out.append(laid(lambda c, n: F.array_repeat(c["segment"].cast("int"), n), zero).alias(f"{f}_segment_ids"))
            out.append(laid(lambda c, n: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda x: x.cast("int"))).otherwise(F.array().cast("array<int>")), zero).alias(f"{f}_positions"))
    out += [F.transform("_cells", field(f"_m{i}")).alias(m) for i, m in enumerate(meta)]
    return rows.select(F.col("row").alias(IDX), *out)


def _filler(df: DataFrame, feature: str, element: str, pad) -> Column:
    """One cell of padding; for cells that are arrays, of the shape that the first element with a cell shows."""
    sizes, at = [], F.col(feature)
    while element.startswith("array<"):
        at, element = F.get(at, F.lit(0)), element.removeprefix("array<")[:-1]
        sizes.append(F.size(at))
    fill = F.lit(pad).cast(element)
    shape = df.where(F.size(feature) > 0).select(*sizes).first() if sizes else ()
    for n in reversed(shape or [0] * len(sizes)):
        fill = F.array_repeat(fill, max(n, 0))
    return fill


def _lengths(df: DataFrame, features: Sequence[str], grouped: str | None = None) -> DataFrame:
    kinds = dict(df.dtypes)
    values = [F.array_distinct(F.col(grouped).cast("array<double>")).alias("values")] if grouped else []
    return df.select(IDX, F.array(*[(F.size(f) if kinds[f].startswith("array") else F.lit(1)).cast("long") for f in features]).alias("len"), *values)


def pack_bins(df: DataFrame, lengths: Mapping[str, int], bins: int, best: bool = False, workers: int = 1, meta: Sequence[str] = (), pad: Mapping[str, object] | None = None, align: Mapping[str, int] | None = None, max_sequences_per_bin: int | None = None, seed: int = 0, shuffle_bins: bool = True, shuffle_bins_group_by_feature: str | None = None, block: int | None = None, start: tuple[int, int] = (0, 0), borders: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """First-fit (or best-fit) packed rows of the array columns named in lengths; df has _idx. block, start, borders: see assign_bins.

    shuffle_bins_group_by_feature: a feature of numbers; a batch's rows are sorted by the mean of its distinct values
    other than zero, in the seeded order where they tie.
    """
    df = _as_arrays(df, lengths)
    if shuffle_bins_group_by_feature is not None and shuffle_bins_group_by_feature not in lengths:
        raise ValueError(f"{shuffle_bins_group_by_feature} is no packed feature")
    options = {"align": [(align or {}).get(f, 1) for f in lengths], "most": max_sequences_per_bin, "seed": seed, "shuffle_bins": shuffle_bins}
    sizes = _lengths(df, list(lengths), shuffle_bins_group_by_feature if shuffle_bins else None)
    places = assign_bins(sizes, list(lengths.values()), bins, best, workers, block, start, borders, **options)
    return materialise_rows(df, places, lengths, meta, pad)


def pack_and_batch(df: DataFrame, lengths: Mapping[str, int], batch_size: int, max_sequences_per_bin: int | None = None) -> DataFrame:
    """Batches of batch_size first-fit rows: each feature, its _segment_ids and _positions as arrays of rows, and last_index, the last element's index.

    Rows of the last batch that no element reached are zero.
    """
    if batch_size < 1:
        raise ValueError("batch size must be positive")
    rows = pack_bins(df.withColumn("last_index", F.col(IDX)), lengths, batch_size, meta=["last_index"], max_sequences_per_bin=max_sequences_per_bin, shuffle_bins=False)
    rows = rows.withColumn("last_index", F.array_max("last_index"))
    out = blocks(rows, F.expr(f"{IDX} div {batch_size}"), F.pmod(F.col(IDX), F.lit(batch_size)), batch_size)
    kinds = dict(rows.dtypes)
    for f, size in lengths.items():
        for c in (f, f"{f}_segment_ids", f"{f}_positions"):
            blank = F.array_repeat(_filler(df, f, kinds[f].removeprefix("array<")[:-1], 0) if c == f else F.lit(0).cast("int"), size)
            out = out.withColumn(c, F.concat(c, F.array_repeat(blank, F.lit(batch_size) - F.size(c))))
    return out.withColumn("last_index", F.array_max("last_index"))


def concat_then_split(df: DataFrame, lengths: Mapping[str, int], meta: Sequence[str] = (), split_full_length_features: bool = True, bos: Mapping[str, object] | None = None, workers: int = 1) -> DataFrame:
    """Rows of a concatenated stream; bos: a token that replaces the first of each piece, by feature."""
    df = _as_arrays(df, lengths)
    sizes = _lengths(df, list(lengths))
    if len(lengths) == 1 and split_full_length_features and workers == 1:
        span = (df.agg(F.max(IDX)).first()[0] or 0) + 1
        places = assign_prefix_sums(sizes, next(iter(lengths.values())), span)
    else:
        places = assign_cuts(sizes, list(lengths.values()), split_full_length_features, workers)
    return materialise_rows(df, places, lengths, meta, bos=bos)


def _as_arrays(df: DataFrame, features: Mapping[str, int]) -> DataFrame:
    """A scalar feature has length one."""
    kinds = dict(df.dtypes)
    return df.withColumns({f: F.array(f) for f in features if not kinds[f].startswith("array")})


def padding_ratio(packed: DataFrame, feature: str) -> float:
    """The share of cells without an element."""
    used = F.size(F.filter(f"{feature}_segment_ids", lambda x: x > 0))
    r = packed.agg(F.sum(used).alias("u"), F.sum(F.size(f"{feature}_segment_ids")).alias("n")).first()
    return 1 - r["u"] / r["n"] if r["n"] else 0.0


def as_pandas(df: DataFrame) -> pd.DataFrame:
    return df.orderBy(IDX).toPandas()
