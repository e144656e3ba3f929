"""Iterator stages over streams: batches, window shuffles and packed rows whose open part is state by lane.

A stage takes a lane's elements one after the other and gives rows out as soon as they are whole; what is open
(a batch's elements, a window's, the bins') is its state, which Spark keeps between micro-batches and restores
with the stream's checkpoint. State is bounded by one batch, window or batch of bins, not by the stream. Rows are
those of the batch form. Elements of a lane have to come in order, as an index stream gives them.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState

from tidewheel.functions.bins import BinPacker
from tidewheel.functions.permutation import permute
from tidewheel.operators.batching import IDX, quoted
from tidewheel.pipeline import MapPipeline, payload
from tidewheel.session import ship
from tidewheel.streaming.index_stream import index_stream


class Stage:
    """From elements to rows; everything that changes is in its fields, which are pickled between micro-batches."""

    def fields(self, given: T.StructType) -> list[T.StructField]:
        """The columns of rows made of elements with these columns."""
        return list(given.fields)

    def put(self, element: dict) -> Iterator[dict]:
        raise NotImplementedError

    def end(self) -> Iterator[dict]:
        """What is still open when the last element has come."""
        return iter(())


class Batches(Stage):
    """Blocks of elements as arrays by column."""

    def __init__(self, size: int, drop_remainder: bool = False):
        if size < 1:
            raise ValueError("batch size must be positive")
        self.size, self.drop_remainder, self.open = size, drop_remainder, []

    def fields(self, given):
        return [T.StructField(f.name, T.ArrayType(f.dataType)) for f in given]

    def _out(self) -> Iterator[dict]:
        block, self.open = self.open, []
        yield {c: [e[c] for e in block] for c in block[0]}

    def put(self, element):
        self.open.append(element)
        if len(self.open) == self.size:
            yield from self._out()

    def end(self):
        if self.open and not self.drop_remainder:
            yield from self._out()


class WindowShuffle(Stage):
    """The order of IterPipeline.window_shuffle."""

    def __init__(self, window: int, seed: int):
        if window < 1:
            raise ValueError("window must be positive")
        self.window, self.seed, self.number, self.open = window, seed, 0, []

    def _out(self) -> Iterator[dict]:
        m = len(self.open)
        place = m - 1 - permute(np.arange(m), m, (self.seed + self.number) % (1 << 32), inverse=True)
        block, self.open, self.number = self.open, [], self.number + 1
        yield from (block[i] for i in np.argsort(place))

    def put(self, element):
        self.open.append(element)
        if len(self.open) == self.window:
            yield from self._out()

    def end(self):
        if self.open:
            yield from self._out()


class Packed(Stage):
    """The rows of IterPipeline.pack: each feature padded, with its segment ids and positions."""

    def __init__(self, lengths: Mapping[str, int], bins: int, best: bool = False, seed: int = 0, shuffle_bins: bool = True, max_sequences_per_bin: int | None = None):
        self.lengths, self.open, self.taken = dict(lengths), {}, 0
        self.packer = BinPacker(list(self.lengths.values()), bins, best, most=max_sequences_per_bin, seed=seed, shuffle_bins=shuffle_bins)

    def fields(self, given):
        whole = T.ArrayType(T.IntegerType())
        return [f for c in self.lengths for f in (T.StructField(c, given[c].dataType), T.StructField(f"{c}_segment_ids", whole), T.StructField(f"{c}_positions", whole))]

    def _rows(self, places: list[tuple]) -> Iterator[dict]:
        rows: dict[int, dict] = {}
        for idx, row, segment, at, size in places:
            element = self.open.pop(idx)
            out = rows.setdefault(row, {k: [0] * n for c, n in self.lengths.items() for k in (c, f"{c}_segment_ids", f"{c}_positions")})
            for c, a, n in zip(self.lengths, at, size, strict=True):
                out[c][a : a + n], out[f"{c}_segment_ids"][a : a + n], out[f"{c}_positions"][a : a + n] = list(element[c]), [segment] * n, list(range(n))
        yield from (rows[r] for r in sorted(rows))

    def put(self, element):
        done = list(self.packer.place(self.taken, [len(element[c]) for c in self.lengths]))
        yield from self._rows(done)
        self.open[self.taken] = element
        self.taken += 1

    def end(self):
        yield from self._rows(list(self.packer.flush()))


def pipeline_stream(ds: MapPipeline, stop: int, step: int = 1000) -> DataFrame:
    """A stream of a pipeline's first `stop` elements, in order, `step` of them at a time."""
    return index_stream(ds.spark, stop, step).join(ds.rows(0, stop), IDX)


def staged(elements: DataFrame, stage: Stage, stop: int, lanes: int = 1) -> DataFrame:
    """A stage over a stream of elements with _idx, of which there will be `stop`; lanes: each takes every lanes-th element.

    Rows have _lane and, by lane, _idx.
    """
    if lanes < 1:
        raise ValueError("lanes must be positive")
    ship(elements.sparkSession)
    names = payload(elements)
    given = T.StructType([elements.schema[c] for c in names])
    out = T.StructType([T.StructField("_lane", T.LongType()), T.StructField(IDX, T.LongType()), *stage.fields(given)])

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own, met, made = pickle.loads(state.get[0]) if state.exists else (pickle.loads(fresh), 0, 0)
        rows = pd.concat(list(frames)).sort_values(IDX)
        if rows[IDX].iloc[0] != key[0] + met * lanes or not (rows[IDX].diff().iloc[1:] == lanes).all():
            raise ValueError(f"lane {key[0]} goes on at {key[0] + met * lanes}, but the stream gives {rows[IDX].iloc[0]}")
        found = []
        for values in zip(*(rows[f"_{i}"] for i in range(len(names))), strict=True):
            found += own.put(dict(zip(names, values, strict=True)))
        met += len(rows)
        if met == len(range(key[0], stop, lanes)):
            found += own.end()
        state.update((pickle.dumps((own, met, made + len(found))),))
        yield pd.DataFrame({"_lane": [key[0]] * len(found), IDX: range(made, made + len(found)), **{f.name: [r[f.name] for r in found] for f in out.fields[2:]}})

    fresh = pickle.dumps(stage)
    rows = elements.select(F.pmod(F.col(IDX), F.lit(lanes)).cast("long").alias("_lane"), IDX, *[F.col(quoted(c)).alias(f"_{i}") for i, c in enumerate(names)])
    return rows.groupBy("_lane").applyInPandasWithState(run, out, "state binary", "append", "NoTimeout")
