"""Batches: ordered blocks of rows as arrays, or as any aggregates."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

IDX = "_idx"


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return f"`{name.replace('`', '``')}`"


def field(name: str):
    """A function that takes a field of a struct."""
    return lambda r: r[name]


def uneven(values: Column, kind: T.DataType) -> list[Column]:
    """Conditions under which elements of one type differ in shape, one for each depth of their arrays, in structs too."""
    if isinstance(kind, T.StructType):
        return [c for f in kind for c in uneven(F.transform(values, field(f.name)), f.dataType)]
    if not isinstance(kind, T.ArrayType):
        return []
    return [F.size(F.array_distinct(F.transform(values, F.size))) > 1, *uneven(F.flatten(values), kind.elementType)]


def same_shape(values: Column, kind: T.DataType, name: str) -> Column:
    """Fails unless all elements of a batch have one shape."""
    for bad in uneven(values, kind):
        values = F.when(bad, F.raise_error(F.lit(f"elements of {name} have different shapes"))).otherwise(values)
    return values


def stacked(values: Column, kind: T.DataType, missing: Column | None = None, fill: object = None) -> Column:
    """Elements as one array; structs as structs of arrays. missing: how many fillers follow (a struct's by field, 0 unless named)."""
    if isinstance(kind, T.StructType) and len(kind):
        by = fill if isinstance(fill, Mapping) else {}
        return F.struct(*[stacked(F.transform(values, field(f.name)), f.dataType, missing, by.get(f.name)).alias(f.name) for f in kind])
    if missing is None:
        return values
    filler = F.lit(None if isinstance(kind, T.ArrayType) else 0 if fill is None else fill).cast(kind)
    return F.concat(values, F.array_repeat(filler, missing))


def unstacked(batch: Column, kind: T.DataType) -> Column:
    """The elements of a batched column as one array: the inverse of stacked."""
    if not isinstance(kind, T.StructType):
        return batch
    return F.arrays_zip(*[unstacked(batch[f.name], f.dataType).alias(f.name) for f in kind])


#: Columns of the engine, which are no part of an element.
RESERVED = (IDX, "_present", "_lane", "_record")


def blocks(df: DataFrame, number: Column, place: Column, size: int, aggregates: Sequence[Column] | None = None, pad: Mapping[str, object] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """A row for each block number (its _idx) of each lane (by): each column as an array in order of place, or the aggregates.

    Structs become structs of arrays. pad: values that fill a short block's arrays up to size; those of a
    struct by its fields' names.
    """
    names = [c for c in df.columns if c not in RESERVED]
    kinds = {f.name: f.dataType for f in df.schema}
    df = df.withColumn("_tw_block", number.cast("long"))
    if aggregates is not None:
        return df.groupBy(*by, "_tw_block").agg(*aggregates).withColumnRenamed("_tw_block", IDX)
    rows = df.select(*by, "_tw_block", F.struct(place.alias("_tw_place"), *map(quoted, names)).alias("_tw_row"))
    out = rows.groupBy(*by, "_tw_block").agg(F.array_sort(F.collect_list("_tw_row")).alias("_tw_rows"))
    columns = []
    for c in names:
        values = F.transform("_tw_rows", field(c))
        if pad is None:
            values = stacked(same_shape(values, kinds[c], c), kinds[c])
        else:
            values = stacked(values, kinds[c], F.lit(size) - F.size("_tw_rows"), pad.get(c))
        columns.append(values.alias(c))
    return out.select(F.col("_tw_block").alias(IDX), *by, *columns)


def custom(df: DataFrame, number: Column, place: Column, function: Callable[[pd.DataFrame], Mapping[str, object]], schema: str, by: Sequence[str] = ()) -> DataFrame:
    """A row for each block: what a function makes of its elements, which it gets in order."""
    names = [c for c in df.columns if c not in RESERVED]
    kind = T.StructType.fromDDL(schema)
    out = T.StructType([T.StructField(IDX, T.LongType()), *(T.StructField(b, T.LongType()) for b in by), *kind.fields])
    rows = df.select(number.cast("long").alias("_tw_block"), *[F.col(b).cast("long").alias(b) for b in by], place.alias("_tw_place"), *[F.col(quoted(c)).alias(f"_tw_{i}") for i, c in enumerate(names)])

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("_tw_place")
        made = function(block[[f"_tw_{i}" for i in range(len(names))]].set_axis(names, axis=1).reset_index(drop=True))
        own = {IDX: block["_tw_block"].iloc[0], **{b: block[b].iloc[0] for b in by}}
        return pd.DataFrame({f.name: [own[f.name] if f.name in own else made[f.name]] for f in out.fields})

    return rows.groupBy("_tw_block", *by).applyInPandas(run, out)
