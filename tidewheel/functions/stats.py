"""Element specs, execution summaries and worker advice."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.pipeline import IterPipeline, MapPipeline


def element_spec(ds: MapPipeline | IterPipeline) -> T.StructType:
    df = ds.rows(0, 1) if isinstance(ds, MapPipeline) else ds.frame()
    return T.StructType([f for f in df.schema if f.name not in ("_idx", "_present")])


def _chain(ds) -> list:
    out, queue = [], [ds]
    while queue:
        node = queue.pop(0)
        out.append(node)
        queue += node._parents
    return out


def execution_summary(ds: IterPipeline) -> DataFrame:
    """A row for each node: its id, name, parents, elements, and seconds to produce them all."""
    nodes = _chain(ds)
    rows = []
    for i, node in enumerate(nodes):
        began = time.perf_counter()
        df = node.frame() if isinstance(node, IterPipeline) else node.epoch() if node.n is not None else node.rows(0, 0)
        n = df.agg(F.count(F.lit(1))).first()[0]
        rows.append((i, (node.note[0] if getattr(node, "note", ()) else type(node).__name__.lstrip("_")), [nodes.index(p) for p in node._parents], n, time.perf_counter() - began))
    return ds.spark.createDataFrame(rows, "id int, name string, inputs array<int>, elements long, seconds double")


def graph(ds) -> str:
    """The nodes and what they give, outermost first."""
    return "\n".join(f"{type(n).__name__.lstrip('_')} <- {[type(p).__name__.lstrip('_') for p in n._parents]}" for n in _chain(ds))


@dataclass(frozen=True)
class PerformanceConfig:
    workers: int
    buffer: int


def pick_performance_config(ds: IterPipeline, *, ram_budget_mb: float, max_workers: int, max_buffer_size: int | None = None, samples: int = 5) -> PerformanceConfig:
    """Workers and buffered elements that a memory budget allows, by the mean size of a few elements."""
    if ram_budget_mb <= 0 or max_workers < 1:
        raise ValueError("the budget and the workers must be positive")
    rows = ds.frame().where(F.col("_idx") < samples).select(F.length(F.to_json(F.struct("*"))).alias("n")).collect()
    size = max(1.0, sum(r["n"] for r in rows) / max(len(rows), 1))
    budget = ram_budget_mb * (1 << 20)
    workers = max(1, min(int(budget / size), max_workers))
    return PerformanceConfig(workers, max(1, min(int(budget / (size * workers)), max_buffer_size or 1000)))
