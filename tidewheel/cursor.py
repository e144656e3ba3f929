"""A driver-side cursor over a pipeline's rows, whose whole state is a small JSON object.

A state holds marks of the nodes that need more than an index to go on from (packing: a batch's first element and
the rows before it), so a restored cursor computes what comes after them and asks the source for no earlier rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Row
from pyspark.sql import functions as F

from tidewheel.functions.schedules import Shard
from tidewheel.operators.batching import RESERVED
from tidewheel.pipeline import IterPipeline, MapPipeline, elastic_batches
from tidewheel.sources import files


class Cursor(Iterator):
    """Rows in order. The state names the plan and the next index, so it outlives any change of partitions."""

    def __init__(self, ds: IterPipeline, extra: dict | None = None):
        self._ds, self._extra, self._next, self._rows, self._closed = ds, extra or {}, 0, None, False

    def __next__(self) -> Row:
        if self._closed:
            raise ValueError("the cursor is closed")
        if self._rows is None:
            df = self._ds.frame_from(self._next).orderBy("_idx")
            self._rows = df.drop(*RESERVED).toLocalIterator(prefetchPartitions=True)
        row = next(self._rows)
        self._next += 1
        return row

    def get_state(self) -> dict:
        return {"version": 1, "plan": self._ds.signature(), "next_index": self._next, "marks": self._ds.marks(self._next), **self._extra}

    def set_state(self, state: dict) -> None:
        for k, v in {"version": 1, "plan": self._ds.signature(), **self._extra}.items():
            if state.get(k) != v:
                raise ValueError(f"the state is another pipeline's: its {k} is {state.get(k)!r}, not {v!r}")
        self._ds.resume(state.get("marks", []))
        self._next, self._rows = state["next_index"], None

    def get_next_index(self) -> int:
        return self._next

    def set_next_index(self, index: int) -> None:
        if index < 0 or index > self._ds.count():
            raise IndexError(f"{index} is out of range")
        self._next, self._rows = index, None

    def save(self, folder: str, process: int = 0, of: int = 1) -> str:
        """Writes the state to a folder on any file system that Spark reaches."""
        path = f"{folder.rstrip('/')}/process_{process}-of-{of}.json"
        files.write_text(self._ds.spark, path, json.dumps(self.get_state()))
        return path

    def load(self, folder: str, process: int = 0, of: int = 1) -> None:
        self.set_state(json.loads(files.read_text(self._ds.spark, f"{folder.rstrip('/')}/process_{process}-of-{of}.json")))

    def close(self) -> None:
        self._closed, self._rows = True, None


class ElasticCursor(Iterator):
    """A host's batches of a MapPipeline; the state is a global position, from which any number of hosts can go on."""

    def __init__(self, ds: MapPipeline, global_batch: int, shard: Shard, extra: dict | None = None):
        self._ds, self._batch, self._shard, self._extra, self._at, self._rows = ds, global_batch, shard, extra or {}, 0, None
        elastic_batches(ds, global_batch, shard)  # checks the arguments

    def __next__(self) -> Row:
        if self._rows is None:
            df = elastic_batches(self._ds, self._batch, self._shard, self._at).frame().orderBy("_idx")
            self._rows = df.drop("_idx").toLocalIterator(prefetchPartitions=True)
        row = next(self._rows)
        self._at += self._batch
        return row

    def get_state(self) -> dict:
        return {"version": 1, "plan": self._ds.signature(), "global_next_index": self._at, **self._extra}

    def set_state(self, state: dict) -> None:
        if state.get("plan") != self._ds.signature():
            raise ValueError("the state is another pipeline's")
        self._at, self._rows = state["global_next_index"], None

    def save(self, folder: str) -> str:
        path = f"{folder.rstrip('/')}/shard_state_{self._at}_{self._shard.index}-of-{self._shard.count}.json"
        files.write_text(self._ds.spark, path, json.dumps(self.get_state()))
        return path

    def load(self, folder: str) -> None:
        """From the last position at which all hosts of some layout saved their states; what only some of them saved doesn't count."""
        sets: dict[tuple[int, int], list[str]] = {}
        for p in files.matching(self._ds.spark, f"{folder.rstrip('/')}/shard_state_*.json"):
            at, _, count = re.fullmatch(r"shard_state_(\d+)_(\d+)-of-(\d+)\.json", p.rsplit("/", 1)[-1]).groups()
            sets.setdefault((int(at), int(count)), []).append(p)
        whole = {k: ps for k, ps in sets.items() if len(ps) == k[1]}
        if not whole:
            raise ValueError(f"there is no state of all hosts in {folder}")
        self.set_state(json.loads(files.read_text(self._ds.spark, whole[max(whole)][0])))


def assert_equal_after_restore(ds: IterPipeline) -> None:
    """From each state the rest of the rows comes out again."""
    cursor = Cursor(ds)
    rows, states = [], [cursor.get_state()]
    for row in cursor:
        rows.append(row)
        states.append(cursor.get_state())
    for i, state in enumerate(states):
        other = Cursor(ds)
        other.set_state(state)
        assert list(other) == rows[i:], f"the rows after state {i} differ"
