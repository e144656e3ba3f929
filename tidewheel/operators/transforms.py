"""Declarative transformations: objects that a pipeline applies by their kind."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column


@dataclass
class Map:
    columns: Mapping[str, Column | str]


@dataclass
class MapWithIndex:
    f: Callable[[Column], Mapping[str, Column]]


@dataclass
class RandomMap:
    draw: Callable
    returns: str
    name: str = "value"
    inputs: Sequence[str] = ()
    seed: int | None = None


@dataclass
class Filter:
    condition: Column | str


@dataclass
class FlatMap:
    array: Column | str
    max_fan_out: int = 1
    name: str = "value"


@dataclass
class Batch:
    size: int
    drop_remainder: bool = False
    aggregates: Sequence[Column] | None = None
    pad: Mapping[str, object] | None = field(default=None)
    function: Callable | None = None
    schema: str | None = None


def apply_one(ds, t):
    from tidewheel.pipeline import MapPipeline

    match t:
        case Map():
            return ds.map(**t.columns)
        case MapWithIndex():
            return ds.map_with_index(t.f)
        case RandomMap():
            return ds.random_map(t.draw, t.returns, t.name, t.inputs, t.seed)
        case Filter():
            return ds.filter(t.condition)
        case FlatMap():
            return ds.flat_map(t.array, t.max_fan_out, t.name) if isinstance(ds, MapPipeline) else ds.flat_map(t.array, t.name, t.max_fan_out)
        case Batch():
            return ds.batch(t.size, drop_remainder=t.drop_remainder, aggregates=t.aggregates, pad=t.pad, function=t.function, schema=t.schema)
    if callable(t):
        return t(ds)
    raise NotImplementedError(f"{type(t).__name__} is no transformation")


def apply_all(ds, transforms):
    return reduce(apply_one, transforms if isinstance(transforms, Sequence) else [transforms], ds)
