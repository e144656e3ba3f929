"""The fluent pipelines: MapPipeline (random access, endless by epochs) and IterPipeline (a finite order).

Nodes never look records up. Each node maps the rows of its parents to their places in its own output:
a shuffle applies the inverse permutation to _idx, a slice filters and renumbers, a mix computes where an
input's j-th row stands, and so on. These are narrow projections, so a chain of global transformations
costs no exchange; Catalyst sees through Column expressions. Only batches, zips, gathers and re-ranking
move rows. `rows(lo, hi)` gives a node's elements with raw indices in [lo, hi); epoch e of n elements has
the raw indices from e * n on.
"""

from __future__ import annotations

import functools
import hashlib
import re
import sys
import warnings
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextvars import ContextVar
from enum import Enum
from functools import cached_property, reduce
from itertools import islice
from math import gcd
from types import BuiltinFunctionType, CodeType, FunctionType, MethodType, ModuleType

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewheel.functions import schedules
from tidewheel.functions.permutation import permute
from tidewheel.operators import batching, packing
from tidewheel.operators.batching import RESERVED as OWN
from tidewheel.operators.batching import quoted
from tidewheel.plans.ranking import IDX, dense, indexed
from tidewheel.session import ship

#: Reserved columns besides _idx: whether an element is there, a worker's lane, a record's number in its sampler.
PRESENT, LANE, RECORD = "_present", "_lane", "_record"
MOST_GATHERED = 5_000_000
#: Options of a plan: shares of a window of 1,000 elements from which a filter warns or fails (0 and None: never).
OPTIONS: ContextVar[tuple] = ContextVar("options", default=())


class NoLanes(Exception):
    """A stage can't run on all workers' parts at once."""


def told(x: object, within: tuple = ()) -> str:
    """What a function, frame, column or plain value is, the same in every process; raises for what can't be told apart.

    Functions are told by their code, what they close over and the globals that they name; arrays and frames of
    pandas by all their bytes; objects by their class and fields. within: the objects around this one.
    """
    if x is None or isinstance(x, (bool, int, float, complex, str, bytes, Enum)):
        return f"{type(x).__name__}:{x!r}"
    if any(x is y for y in within):
        return f"again:{next(i for i, y in enumerate(within) if x is y)}"
    inner = lambda *parts: f"[{', '.join(told(p, (*within, x)) for p in parts)}]"
    name = f"{getattr(x, '__module__', '')}.{getattr(x, '__qualname__', type(x).__qualname__)}"
    if isinstance(x, _Node):
        return x.signature()
    if isinstance(x, DataFrame):
        files = sorted(f for f in x.inputFiles() if "/tidewheel-" not in f)
        return re.sub(r"#\d+L?|tidewheel-[0-9a-f]+|@[0-9a-f]+", "", x._jdf.queryExecution().analyzed().toString()) + str(files)
    if isinstance(x, Column):
        node = x._jc.node().normalized().toString()
        return f"column:{x}:{hashlib.sha256(re.sub(r'@[0-9a-f]+', '', node).encode()).hexdigest()}"
    if isinstance(x, (np.ndarray, np.generic)):
        plain = x.dtype.hasobject
        return inner(str(x.dtype), x.shape, x.tolist() if plain else hashlib.sha256(np.ascontiguousarray(x).tobytes()).digest())
    if isinstance(x, (pd.DataFrame, pd.Series, pd.Index)):
        return inner(type(x).__name__, list(getattr(x, "columns", ())), np.asarray(pd.util.hash_pandas_object(x)))
    if isinstance(x, (list, tuple)):
        return type(x).__name__ + inner(*x)
    if isinstance(x, (set, frozenset)):
        return type(x).__name__ + str(sorted(inner(y) for y in x))
    if isinstance(x, Mapping):
        return type(x).__name__ + inner(*sorted(x.items(), key=lambda kv: str(kv[0])))
    if isinstance(x, (range, slice, T.DataType, np.dtype, re.Pattern)):
        return repr(x)
    if isinstance(x, CodeType):
        return inner(x.co_code, x.co_names, x.co_varnames, x.co_consts)
    if isinstance(x, FunctionType):
        names = {n for c in _codes(x.__code__) for n in c.co_names}
        outer = [(n, x.__globals__[n]) for n in sorted(names) if n in x.__globals__]
        return "function" + inner(x.__code__, x.__defaults__, x.__kwdefaults__, [c.cell_contents for c in x.__closure__ or ()], outer)
    if isinstance(x, ModuleType):
        return f"module:{x.__name__}"
    if isinstance(x, functools.partial):
        return "partial" + inner(x.func, x.args, x.keywords)
    if isinstance(x, MethodType):
        return "method" + inner(x.__func__, x.__self__)
    if isinstance(x, type):
        own = {k: v for k, v in vars(x).items() if isinstance(v, (FunctionType, classmethod, staticmethod, property, int, float, str, bytes, tuple))}
        ours = x.__module__ == "__main__" or not hasattr(sys.modules.get(x.__module__), "__file__") or "site-packages" not in (sys.modules[x.__module__].__file__ or "")
        return f"class:{name}" + (inner(*sorted((k, v) for k, v in own.items() if k not in ("__module__", "__doc__"))) if ours else "")
    if isinstance(x, (classmethod, staticmethod)):
        return inner(x.__func__)
    if isinstance(x, property):
        return inner(x.fget, x.fset)
    if isinstance(x, (BuiltinFunctionType, np.ufunc)):
        return f"builtin:{name}:{getattr(x, '__name__', '')}"
    fields = {**getattr(x, "__dict__", {}), **{k: getattr(x, k) for c in type(x).__mro__ for k in getattr(c, "__slots__", ()) if hasattr(x, k)}}
    if fields or type(x).__module__ not in ("builtins", "numpy", "numpy.random._generator"):
        if not fields and type(x).__reduce__ is object.__reduce__ and type(x).__basicsize__ > object.__basicsize__ + 16:
            raise ValueError(f"a plan that holds {type(x).__qualname__} can't be told from others, so it has no state to save")
        return "object" + inner(type(x), fields)
    raise ValueError(f"a plan that holds {type(x).__qualname__} can't be told from others, so it has no state to save")


def _codes(code: CodeType) -> Iterator[CodeType]:
    """A function's code and that of the functions inside it."""
    yield code
    for c in code.co_consts:
        if isinstance(c, CodeType):
            yield from _codes(c)


def payload(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in OWN]


def checked(df: DataFrame) -> DataFrame:
    """A source's frame: columns of the engine's names would be taken for its own."""
    taken = sorted(c for c in df.columns if c.lower() in OWN[1:])
    if taken:
        raise ValueError(f"columns {taken} bear names of the engine: rename them")
    return df


def own(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c in OWN]


def windows_lost(df: DataFrame, keep: Column, window: int, by: Sequence[str] = ()) -> DataFrame:
    """win, n, lost: the elements of each window of inputs, and those that a filter drops."""
    return df.groupBy(*by, F.floor(F.col(IDX) / window).alias("win")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~keep).alias("lost"))


def as_column(e: Column | str | Callable, *args: Column) -> Column:
    return e if isinstance(e, Column) else F.expr(e) if isinstance(e, str) else e(*args)


def _div(a: Column, b: int) -> Column:
    """Whole-number division, rounded towards zero."""
    return F.call_function("div", a.cast("long"), F.lit(b).cast("long"))


def permuted(idx: Column, n: Column | int, seed: Column | int, inverse: bool = True) -> Column:
    """A column's places under the bijection of [0, n); sizes and seeds may differ by row."""

    ship(SparkSession.active())

    def run(i: pd.Series, n: pd.Series, s: pd.Series) -> pd.Series:
        out, at, sizes, seeds = np.empty(len(i), np.int64), i.to_numpy(np.int64), n.to_numpy(np.int64), s.to_numpy(np.int64)
        for one in np.unique(sizes):
            rows = sizes == one
            out[rows] = permute(at[rows], int(one), seeds[rows], inverse=inverse)
        return pd.Series(out)

    run.__annotations__ = {"i": pd.Series, "n": pd.Series, "s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "long")(idx, *((x if isinstance(x, Column) else F.lit(x)).cast("long") for x in (n, seed)))


def random_values(idx: Column, seed: int, draw: Callable[[np.random.Generator], object], returns: str, *inputs: Column, record: bool = False) -> Column:
    """draw(rng, *inputs) by row, with the row's own generator; record: of the seed that idx is added to, as samplers give it."""
    ship(SparkSession.active())

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        own = (lambda at: np.random.Generator(np.random.Philox(key=seed + at))) if record else schedules.element_generators(seed)
        for i, *rest in batches:
            yield pd.Series([draw(own(at), *row) for at, *row in zip(i.tolist(), *(r.tolist() for r in rest), strict=True)])

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, returns)(idx, *inputs) if inputs else F.pandas_udf(_alone(run), returns)(idx)


def _alone(run: Callable) -> Callable:
    def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from run((i,) for i in batches)

    one.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return one


class _Node:
    _parents: tuple = ()
    _seed: int | None = None

    @property
    def spark(self) -> SparkSession:
        return self._parents[0].spark

    def default_seed(self) -> int:
        """Derived from the nearest seed() above on each branch, and how far away it stands."""
        queue, pairs = [(self, 0)], []
        while queue:
            node, depth = queue.pop(0)
            if node._seed is not None:
                pairs.append((node._seed, depth))
            else:
                queue += [(p, depth + 1) for p in node._parents]
        if not pairs:
            raise ValueError("a random transformation needs a seed, its own or one from seed()")
        return schedules.default_seed(pairs)

    def _seeded(self, seed: int | None) -> int:
        if seed is None:
            return self.default_seed()
        if not 0 <= seed < 1 << 32:
            raise ValueError("seed must be in [0, 2**32)")
        return seed

    def signature(self) -> str:
        """A digest of the plan: its nodes, their functions and arguments, and the sources' plans and files."""
        skip = ("parent", "lanes", "_gapped", "_parents", "_count", "_counts", "_known", "form", "_f", "_cached", "_make", "_spark", "_context", "_since", "_above", "_pack", "_borders", "_mark", "_workers", "_parts", "_names", "_at", "_given")
        own = [(k, told(v)) for k, v in sorted(self.__dict__.items()) if k not in skip]
        text = f"{type(self).__name__}{own}{[p.signature() for p in self._parents]}"
        return hashlib.sha256(text.encode()).hexdigest()[:16]

    def pipe(self, f: Callable, *args, **kwargs):
        return f(self, *args, **kwargs)

    def apply(self, transforms):
        from tidewheel.operators.transforms import apply_all

        return apply_all(self, transforms)


class MapPipeline(_Node):
    """n: elements of an epoch; None is endless. sparse: elements may be absent."""

    n: int | None = 0
    sparse = False

    def rows(self, lo: int, hi: int) -> DataFrame:
        raise NotImplementedError

    def __len__(self) -> int:
        return self.n if self.n is not None else (1 << 63) - 1

    def epoch(self, number: int = 0) -> DataFrame:
        """One epoch's elements with _idx (and _present)."""
        if self.n is None:
            raise ValueError("an endless pipeline needs a range: rows(lo, hi)")
        return self.rows(number * self.n, (number + 1) * self.n)

    @staticmethod
    def source(df: DataFrame, n: int | None = None) -> MapPipeline:
        """df has a dense _idx (see plans.ranking.with_index); n: its rows, counted if not given."""
        ship(df.sparkSession)
        return _Source(checked(df), df.count() if n is None else n)

    @staticmethod
    def ordered(df: DataFrame, *order: str | Column) -> MapPipeline:
        """The rows of df in a total order of their columns."""
        ship(df.sparkSession)
        return _Source(*indexed(checked(df), *order))

    @staticmethod
    def range(spark: SparkSession, start: int, stop: int | None = None, step: int = 1) -> MapPipeline:
        return _Range(spark, start, stop, step)

    @staticmethod
    def mix(inputs: Sequence[MapPipeline], weights: Sequence[float] | None = None) -> MapPipeline:
        return _Mix(list(inputs), weights)

    @staticmethod
    def concatenate(inputs: Sequence[MapPipeline]) -> MapPipeline:
        return _Concatenate(list(inputs))

    @staticmethod
    def select_from(inputs: Sequence[MapPipeline], selection: Sequence[tuple[int, int]] | DataFrame) -> MapPipeline:
        """selection: (input, its index) of each output element, or a frame of any size with _idx (dense), input and index."""
        return _Select(list(inputs), selection)

    @staticmethod
    def zip(inputs: Sequence[MapPipeline]) -> MapPipeline:
        return _Zip(list(inputs))

    def seed(self, seed: int) -> MapPipeline:
        return _Seeded(self, self._seeded(seed))

    def map(self, **columns: Column | str) -> MapPipeline:
        """New payload columns (others go unless mapped)."""
        return _MapColumns(self, lambda df, idx: df.select(*own(df), *[as_column(e).alias(k) for k, e in columns.items()]), ("map", columns))

    def map_or_drop(self, **columns: Column | str) -> MapPipeline:
        """As map, but an element whose new columns are all null is absent from here on."""
        def f(df, idx):
            made = df.select(*own(df), *[as_column(e).alias(k) for k, e in columns.items()])
            here = F.coalesce(*[F.when(F.col(k).isNotNull(), F.lit(True)) for k in columns], F.lit(False))
            return made.withColumn(PRESENT, F.col(PRESENT) & here if PRESENT in made.columns else here)

        node = _MapColumns(self, f, ("map_or_drop", columns))
        node.sparse = True
        return node

    def map_with_index(self, f: Callable[[Column], Mapping[str, Column]]) -> MapPipeline:
        """f(raw index) gives the new columns."""
        return _MapColumns(self, lambda df, idx: df.select(*own(df), *[e.alias(k) for k, e in f(idx).items()]), ("map_with_index", f(F.col(IDX))))

    def map_pandas(self, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> MapPipeline:
        """f works on Arrow batches and keeps _idx; schema leaves _idx out."""
        return _MapColumns(self, lambda df, idx: df.mapInPandas(lambda it: (f(b) for b in it), f"{IDX} bigint, {schema}"), ("map_pandas", f, schema))

    def random_map(self, draw: Callable, returns: str, name: str = "value", inputs: Sequence[str] = (), seed: int | None = None) -> MapPipeline:
        """Adds a column draw(rng, *inputs) with a generator of the element's own."""
        node = _MapColumns(self, None, ("random_map", draw, returns, name, inputs, seed))
        own_seed = node._seeded(seed)
        node._f = lambda df, idx: df.withColumn(name, random_values(idx, own_seed, draw, returns, *map(F.col, inputs)))
        return node

    def filter(self, condition: Column | str) -> MapPipeline:
        return _Filter(self, condition)

    def shuffle(self, seed: int | None = None) -> MapPipeline:
        return _Shuffle(self, seed)

    def window_shuffle(self, window: int, seed: int, clip_last: bool = False) -> MapPipeline:
        return _WindowShuffle(self, window, seed, clip_last)

    def slice(self, sl: slice | Sequence[int]) -> MapPipeline:
        return _Slice(self, sl) if isinstance(sl, slice) else _Select([self], [(0, int(i)) for i in sl])

    def __getitem__(self, sl):
        if isinstance(sl, int):
            got = self.rows(sl % len(self) if sl < 0 else sl, (sl % len(self) if sl < 0 else sl) + 1)
            got = got.where(PRESENT) if PRESENT in got.columns else got
            return got.select(*map(quoted, payload(got))).first()
        return self.slice(sl)

    def shard(self, shard: schedules.Shard) -> MapPipeline:
        """A contiguous even part."""
        lo, hi = schedules.even_split(self.n, shard)
        return _Slice(self, slice(lo, hi))

    def repeat(self, epochs: int | None = None, *, reseed_each_epoch: bool = True) -> MapPipeline:
        return _Repeat(self, epochs, reseed_each_epoch)

    def batch(self, size: int, *, drop_remainder: bool = False, aggregates: Sequence[Column] | None = None, pad: Mapping[str, object] | None = None, function: Callable[[pd.DataFrame], Mapping[str, object]] | None = None, schema: str | None = None) -> MapPipeline:
        """Blocks as arrays, as aggregates, or as the row of `schema` that a function makes of a block's elements in order."""
        return _Batch(self, size, drop_remainder, aggregates, pad, function, schema)

    def flat_map(self, array: Column | str, fan_out: int, name: str = "value") -> MapPipeline:
        return _FlatMap(self, array, fan_out, name)

    def to_iter(self, *, allow_nones: bool = False) -> IterPipeline:
        return _ToIter(self, allow_nones)


def _epochs(df: DataFrame, n: int, lo: int, hi: int) -> DataFrame:
    """Rows of one epoch (_idx below n), repeated for each epoch that [lo, hi) touches."""
    if n == 0 or hi <= lo:
        return df.where(F.lit(False))
    first, last = lo // n, (hi - 1) // n
    if first == last == 0:
        out = df
    elif first == last:
        out = df.withColumn(IDX, F.col(IDX) + first * n)
    else:
        out = df.withColumn("_tw_e", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long")))).withColumn(IDX, F.col(IDX) + F.col("_tw_e") * n).drop("_tw_e")
    return out if lo == first * n and hi == (last + 1) * n else out.where((F.col(IDX) >= lo) & (F.col(IDX) < hi))


def _whole(n: int, lo: int, hi: int) -> tuple[int, int]:
    """The epochs' range around [lo, hi)."""
    return (lo // n * n, ((hi - 1) // n + 1) * n) if n and hi > lo else (0, 0)


def _cut(df: DataFrame, lo: int, hi: int, full: tuple[int, int]) -> DataFrame:
    return df if (lo, hi) == full else df.where((F.col(IDX) >= lo) & (F.col(IDX) < hi))


class _Source(MapPipeline):
    def __init__(self, df: DataFrame, n: int):
        self._df, self.n = df, n

    @property
    def spark(self):
        return self._df.sparkSession

    def rows(self, lo, hi):
        return _epochs(self._df.withColumn(IDX, F.col(IDX).cast("long")), self.n, lo, hi)


class _Range(MapPipeline):
    def __init__(self, spark, start, stop, step):
        if step == 0:
            raise ValueError("step must not be zero")
        self._spark = spark
        self.r = range(start) if stop is None else range(start, stop, step)
        self.n = len(self.r)

    @property
    def spark(self):
        return self._spark

    def rows(self, lo, hi):
        df = self._spark.range(lo, hi if self.n else lo).withColumnRenamed("id", IDX)
        return df.withColumn("value", F.lit(self.r.start) + F.pmod(F.col(IDX), F.lit(max(self.n, 1))) * self.r.step)


class _One(MapPipeline):
    """One parent, same length unless set."""

    def __init__(self, parent: MapPipeline):
        self._parents, self.n, self.sparse = (parent,), parent.n, parent.sparse
        self.parent = parent


class _Seeded(_One):
    def __init__(self, parent, seed):
        super().__init__(parent)
        self._seed = seed

    def rows(self, lo, hi):
        return self.parent.rows(lo, hi)


class _MapColumns(_One):
    def __init__(self, parent, f, note=()):
        super().__init__(parent)
        self._f, self.note = f, note

    def rows(self, lo, hi):
        return self._f(self.parent.rows(lo, hi), F.col(IDX))


class _Filter(_One):
    def __init__(self, parent, condition):
        super().__init__(parent)
        self.condition, self.sparse = condition, True

    def rows(self, lo, hi):
        df = self.parent.rows(lo, hi)
        passes = F.coalesce(as_column(self.condition), F.lit(False))
        return df.withColumn(PRESENT, (F.col(PRESENT) & passes) if PRESENT in df.columns else passes)


class _Shuffle(_One):
    def __init__(self, parent, seed):
        super().__init__(parent)
        self.seed_ = self._seeded(seed)
        if self.n is None:
            raise ValueError("an endless pipeline can't be shuffled: shuffle before repeat")

    def rows(self, lo, hi):
        full = _whole(self.n, lo, hi)
        df = self.parent.rows(*full)
        epoch = _div(F.col(IDX), max(self.n, 1))
        seed = F.pmod(F.lit(self.seed_).cast("long") + epoch, F.lit(1 << 32))
        return _cut(df.withColumn(IDX, epoch * self.n + permuted(F.pmod(F.col(IDX), F.lit(max(self.n, 1))), self.n, seed)), lo, hi, full)


class _WindowShuffle(_One):
    def __init__(self, parent, window, seed, clip_last):
        super().__init__(parent)
        if window < 1:
            raise ValueError("window must be positive")
        self.window, self.seed_, self.clip_last = window, self._seeded(seed), clip_last

    def rows(self, lo, hi):
        w, n = self.window, self.n
        if not n or hi <= lo:
            return self.parent.rows(0, 0)
        first, last = lo // n, (hi - 1) // n
        windows = -(-n // w)
        tail = n - (windows - 1) * w
        # A short last window is drawn from the whole window, which reaches into the next epoch (or several, if they are shorter).
        more = 0 if self.clip_last or tail == w else windows * w - n
        reach = -(-more // n)
        df = self.parent.rows(first * n, (last + 1 + reach) * n)
        epoch, off = _div(F.col(IDX), n), F.pmod(F.col(IDX), F.lit(n))
        if more:  # a row stands in its own epoch, and in the last window of those before that reach it
            back = F.explode(F.expr(f"filter(sequence(0, {reach}), b -> b = 0 or pmod({IDX}, {n}) + b * {n} < {windows * w})"))
            df = df.withColumn("_tw_back", back)
            epoch, off = epoch - F.col("_tw_back"), off + F.col("_tw_back") * n
        df = df.withColumns({"_tw_e": epoch, "_tw_r": off}).where(F.col("_tw_e").between(first, last))
        number = _div(F.col("_tw_r"), w)
        seed = F.pmod(F.lit(self.seed_).cast("long") + number, F.lit(1 << 32))
        size = F.when(number == windows - 1, tail).otherwise(w) if self.clip_last and tail < w else w
        place = number * w + permuted(F.pmod("_tw_r", F.lit(w)), size, seed)
        out = df.withColumn("_tw_p", place).where(F.col("_tw_p") < n).withColumn(IDX, F.col("_tw_e") * n + F.col("_tw_p"))
        return _cut(out.drop("_tw_back", "_tw_e", "_tw_r", "_tw_p"), lo, hi, (first * n, (last + 1) * n))


class _Slice(_One):
    def __init__(self, parent, sl):
        super().__init__(parent)
        if parent.n is None:
            raise ValueError("an endless pipeline can't be sliced as a whole")
        self.r = range(*sl.indices(parent.n))
        self.n = len(self.r)

    def rows(self, lo, hi):
        r, m = self.r, self.n
        if not m or hi <= lo:
            return self.parent.rows(0, 0)
        first, last = lo // m, (hi - 1) // m
        low, high = min(r[0], r[-1]), max(r[0], r[-1])
        n = self.parent.n
        df = self.parent.rows(first * n + low, last * n + high + 1)
        inside = F.pmod(F.col(IDX), F.lit(n))
        off = inside - r.start
        keep = (inside >= low) & (inside <= high) & (F.pmod(off, F.lit(abs(r.step))) == 0)
        return _cut(df.where(keep).withColumn(IDX, _div(F.col(IDX), n) * m + (off / r.step).cast("long")), lo, hi, (first * m, (last + 1) * m))


class _Repeat(_One):
    def __init__(self, parent, epochs, reseed):
        super().__init__(parent)
        if epochs is not None and epochs <= 0:
            raise ValueError("epochs must be positive")
        if parent.n is None:
            raise ValueError("an endless pipeline can't be repeated")
        self.epochs, self.reseed, self.n = epochs, reseed, 0 if parent.n == 0 else None if epochs is None else parent.n * epochs

    def rows(self, lo, hi):
        return self.parent.rows(lo, hi) if self.reseed else _epochs(self.parent.rows(0, self.parent.n), self.parent.n, lo, hi)


class _Many(MapPipeline):
    def __init__(self, inputs: list[MapPipeline]):
        if not inputs:
            raise ValueError("inputs are needed")
        self._parents, self.sparse = tuple(inputs), any(p.sparse for p in inputs)

    def union(self, parts: list[DataFrame]) -> DataFrame:
        if self.sparse:
            parts = [p if PRESENT in p.columns else p.withColumn(PRESENT, F.lit(True)) for p in parts]
        shapes = {tuple(sorted((f.name, f.dataType.simpleString()) for f in p.schema)) for p in parts}
        if len(shapes) > 1:
            raise ValueError("inputs have different schemas")
        return reduce(DataFrame.unionByName, parts)


class _Concatenate(_Many):
    def __init__(self, inputs):
        super().__init__(inputs)
        if any(p.n is None for p in inputs):
            raise ValueError("an endless input can't be concatenated")
        self.n = sum(p.n for p in inputs)

    def rows(self, lo, hi):
        full = _whole(self.n, lo, hi)
        first, last = full[0] // max(self.n, 1), full[1] // max(self.n, 1)
        parts, off = [], 0
        for p in self._parents:
            df = p.rows(first * p.n, last * p.n)
            m = max(p.n, 1)
            parts.append(df.withColumn(IDX, _div(F.col(IDX), m) * self.n + off + F.pmod(F.col(IDX), F.lit(m))))
            off += p.n
        return _cut(self.union(parts), lo, hi, full)


def _scaled(x: Column, a: int, b: int, up: bool = False) -> Column:
    """x * a / b in whole numbers, rounded down (or up); the product is never taken as a whole, as it may pass 64 bits."""
    g = gcd(a, b)
    a, b = a // g, b // g
    if a * b >= 1 << 62:  # parts beyond that are exact as decimals
        whole = x.cast("decimal(38,0)") * F.lit(a).cast("decimal(20,0)")
        return F.call_function("div", whole + F.lit(b - 1 if up else 0).cast("decimal(20,0)"), F.lit(b).cast("decimal(20,0)")).cast("long")
    rest = F.pmod(x, F.lit(b)) * F.lit(a)
    return _div(x, b) * F.lit(a) + _div(rest + (b - 1 if up else 0), b)


def mix_place(j: Column, parts: Sequence[int], which: int) -> Column:
    """Where the j-th row of an input stands in a mix: the schedule's inverse, in whole numbers."""
    rests = [sum(parts[i:]) for i in range(len(parts))]
    at = _scaled(j.cast("long"), rests[which], parts[which])
    for i in range(which - 1, -1, -1):
        # The m-th row that input i leaves over is at ceil((m + 1) * rest / (rest - part)) - 1.
        at = _scaled(at + 1, rests[i], rests[i] - parts[i], up=True) - 1
    return at


class _Mix(_Many):
    def __init__(self, inputs, weights):
        super().__init__(inputs)
        self.parts = schedules.proportions(weights, len(inputs))
        finite = [len(p) for p in inputs]
        self.n = None if all(p.n is None for p in inputs) else schedules.mix_length(finite, self.parts)

    def rows(self, lo, hi):
        parts = []
        for i, p in enumerate(self._parents):
            df = p.rows(schedules.taken(lo, self.parts, i), schedules.taken(hi, self.parts, i))
            parts.append(df.withColumn(IDX, mix_place(F.col(IDX), self.parts, i)))
        return self.union(parts)


class _Select(_Many):
    """Gathers elements by (input, index); the only lookup among the nodes."""

    def __init__(self, inputs, selection):
        super().__init__(inputs)
        if isinstance(selection, DataFrame):
            self.selection = selection.select(F.col("input").cast("int").alias("_d"), F.col("index").cast("long").alias("_k"), F.col(IDX).cast("long").alias("_o"))
            rows = self.selection.groupBy("_d").agg(F.min("_k"), F.max("_k"), F.count(F.lit(1))).collect()  # one row for each input
            self.reach, self.n = {r[0]: (r[1], r[2]) for r in rows}, sum(r[3] for r in rows)
            if any(not 0 <= d < len(inputs) for d in self.reach):
                raise ValueError("a selection names no input")
            return
        self.selection = [(int(a), int(b)) for a, b in selection]
        self.n = len(self.selection)
        if self.n > MOST_GATHERED:
            raise ValueError(f"at most {MOST_GATHERED} elements can be gathered by a list: give a frame of selections")
        self.reach = {}
        for d, k in self.selection:
            low, high = self.reach.get(d, (k, k))
            self.reach[d] = (min(low, k), max(high, k))
        if any(not 0 <= d < len(inputs) for d, _ in self.selection):
            raise ValueError("a selection names no input")

    def rows(self, lo, hi):
        m = self.n
        if not m or hi <= lo:
            return self._parents[0].rows(0, 0)
        first, last = lo // m, (hi - 1) // m
        wanted = self.selection
        if not isinstance(wanted, DataFrame):
            chosen = pd.DataFrame({"_d": [d for d, _ in wanted], "_k": [k for _, k in wanted], "_o": np.arange(m)})
            wanted = self.spark.createDataFrame(chosen, "_d int, _k long, _o long")
        wanted = wanted.toDF("_tw_d", "_tw_k", "_tw_o")
        wanted = wanted.withColumn("_tw_e", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))))
        parts = []
        for i, p in enumerate(self._parents):
            if i not in self.reach:
                continue
            n = len(p) if p.n is not None else 0
            df = p.rows(first * n + self.reach[i][0], last * n + self.reach[i][1] + 1)
            one = wanted.where(F.col("_tw_d") == i).withColumn("_tw_raw", F.col("_tw_k") + F.col("_tw_e") * n)
            one = F.broadcast(one) if m * (last - first + 1) <= 100_000 else one
            parts.append(df.join(one, df[IDX] == one["_tw_raw"]).withColumn(IDX, F.col("_tw_o") + F.col("_tw_e") * m).drop("_tw_d", "_tw_k", "_tw_o", "_tw_e", "_tw_raw"))
        return _cut(self.union(parts), lo, hi, (first * m, (last + 1) * m))


class _Zip(_Many):
    """Tuples by position; columns are prefixed with the input's number. Absent elements stay as nulls."""

    def __init__(self, inputs):
        super().__init__(inputs)
        if len({p.n for p in inputs}) > 1:
            raise ValueError("inputs have different lengths")
        self.n, self.sparse = inputs[0].n, False

    def rows(self, lo, hi):
        out = None
        for i, p in enumerate(self._parents):
            df = p.rows(lo, hi)
            here = F.col(PRESENT) if PRESENT in df.columns else F.lit(True)
            part = df.select(IDX, F.when(here, F.struct(*map(quoted, payload(df)))).alias(f"_{i + 1}"))
            out = part if out is None else out.join(part, IDX)
        return out


class _Batch(_One):
    def __init__(self, parent, size, drop, aggregates, pad, function, schema):
        super().__init__(parent)
        if size < 1:
            raise ValueError("batch size must be positive")
        if parent.sparse:
            raise ValueError("elements may be absent here: turn to_iter() before batch")
        self.size, self.drop, self.form = size, drop, _form(size, aggregates, pad, function, schema)
        self.n = None if parent.n is None else parent.n // size if drop else -(-parent.n // size)
        self.note = ("batch", size, drop, aggregates, pad, function, schema)

    def rows(self, lo, hi):
        m, n, b = self.n, self.parent.n, self.size
        if n is None:
            return self.form(self.parent.rows(lo * b, hi * b), _div(F.col(IDX), b), F.pmod(F.col(IDX), F.lit(b)))
        full = _whole(m, lo, hi)
        if not m:
            return self.form(self.parent.rows(0, 0), F.col(IDX), F.col(IDX))
        df = self.parent.rows(full[0] // m * n, full[1] // m * n)
        r = F.pmod(F.col(IDX), F.lit(n))
        df = df.where(r < m * b) if self.drop else df
        number = _div(F.col(IDX), n) * m + _div(r, b)
        return _cut(self.form(df, number, F.pmod(r, F.lit(b))), lo, hi, full)


def _form(size: int, aggregates, pad, function, schema) -> Callable[..., DataFrame]:
    """How blocks are made of (rows, block number, place in it, lanes)."""
    if function is None:
        return lambda df, number, place, by=(): batching.blocks(df, number, place, size, aggregates, pad, by)
    if schema is None or aggregates is not None or pad is not None:
        raise ValueError("a batch function needs a schema, and neither aggregates nor padding")
    return lambda df, number, place, by=(): batching.custom(df, number, place, function, schema, by)


class _FlatMap(_One):
    def __init__(self, parent, array, fan_out, name):
        super().__init__(parent)
        self.array, self.fan_out, self.name, self.sparse = array, fan_out, name, True
        self.n = None if parent.n is None else parent.n * fan_out

    def rows(self, lo, hi):
        f = self.fan_out
        df = self.parent.rows(lo // f, -(-hi // f))
        df = df.where(PRESENT).drop(PRESENT) if PRESENT in df.columns else df
        a = as_column(self.array)
        sized = F.when(F.size(a) > f, F.raise_error(F.lit(f"an element has more than {f} parts")).cast(df.select(a).schema[0].dataType)).otherwise(a)
        out = df.select(*map(quoted, payload(df)), IDX, F.posexplode(sized).alias("_tw_pos", "_tw_part"))
        out = out.drop(self.name).withColumn(IDX, F.col(IDX) * f + F.col("_tw_pos")).withColumnRenamed("_tw_part", self.name).drop("_tw_pos").withColumn(PRESENT, F.lit(True))
        return _cut(out, lo, hi, (lo // f * f, -(-hi // f) * f))


class IterPipeline(_Node):
    """A finite order: frame() has _idx, dense from 0, and the payload.

    lanes: workers' parts that stand side by side in one frame, each with its own _idx (_lane says whose). What
    can't work on all of them at once raises NoLanes, and parallel() then builds the parts one by one.
    """

    lanes = 1
    #: A worker's number and the workers' count where its part stands alone, and the sampler's seed for records.
    _context: tuple = (0, 1, None)

    def frame(self) -> DataFrame:
        cached = self.__dict__.setdefault("_cached", {})
        if OPTIONS.get() not in cached:
            cached[OPTIONS.get()] = self._frame()
        return cached[OPTIONS.get()]

    def _frame(self) -> DataFrame:
        raise NotImplementedError

    #: frame_from of a node that can do without the rows before.
    _since: Callable[[int], DataFrame] | None = None
    #: Where a node's parent stands when the node stands at an index, if that follows from the index alone.
    _above: Callable[[int], int] | None = None

    def frame_from(self, lo: int) -> DataFrame:
        """The elements from an index on; what stands before is not computed where the plan allows it."""
        return (self._since(lo) if self._since and lo else self.frame()).where(F.col(IDX) >= lo)

    def marks(self, lo: int) -> list[list[int]]:
        """Snapshots from which frame_from(lo) can go on, of this node and those above it: small numbers for a state."""
        return self._parents[0].marks(self._above(lo)) if self._above else []

    def resume(self, marks: Sequence[Sequence[int]]) -> None:
        """Takes the snapshots of an earlier run of the same plan."""
        if self._above and marks:
            self._parents[0].resume(marks)

    def _onwards(self, node: IterPipeline, f: Callable[[DataFrame], DataFrame], step: int = 1) -> IterPipeline:
        """node makes its elements from lo on of those of self from lo * step on."""
        if self.lanes == 1:
            node._since, node._above = (lambda lo: f(self.frame_from(lo * step))), (lambda lo: lo * step)
        return node

    @property
    def _by(self) -> list[str]:
        return [LANE] if self.lanes > 1 else []

    def _alone(self) -> IterPipeline:
        if self.lanes > 1:
            raise NoLanes
        return self

    #: Rows in order whose _idx may have gaps, and a number that none reaches; where a node has it, frame() ranks these rows.
    _gapped: Callable[[], tuple[DataFrame, int]] | None = None

    def _ordered(self) -> tuple[DataFrame, int]:
        """As _gapped, of any node: what a node takes that needs its parent's order, not its ranks."""
        return self._gapped() if self._gapped else (self.frame(), max(self.lane_counts()))

    def _in_order(self, f: Callable[[DataFrame], DataFrame], *note) -> IterPipeline:
        """A node that keeps or drops rows and puts off the ranks of those left."""
        node = self._then(None, *note)
        node._gapped = lambda: (lambda df, span: (f(df), span))(*self._ordered())
        gapped = node._gapped
        node._make = lambda: (lambda df, span: dense(df, IDX, max(span, 1), by=self._by, lanes=self.lanes))(*gapped())
        return node

    def lane_counts(self) -> list[int]:
        """Elements of each lane: by arithmetic where the plan says them, else one look at all."""
        if "_counts" not in self.__dict__:
            self._counts = self._known() if self._known else [self.count()] if self.lanes == 1 else self._looked_up()
        return self._counts

    #: How many elements each lane has, where no look at them is needed.
    _known: Callable[[], list[int]] | None = None

    def _knowing(self, counts: Callable[[], list[int]]) -> IterPipeline:
        self._known = counts
        return self

    def _looked_up(self) -> list[int]:
        found = dict(self._rows().groupBy(LANE).agg(F.count(F.lit(1))).collect())
        return [found.get(w, 0) for w in range(self.lanes)]

    def _rows(self) -> DataFrame:
        """The rows, ranked or not."""
        return self._gapped()[0] if self._gapped else self.frame()

    def _of_lane(self, numbers: Sequence[int]) -> Column:
        return F.lit(numbers[0]) if len(numbers) == 1 else F.element_at(F.lit(list(numbers)), (F.col(LANE) + 1).cast("int"))

    def count(self) -> int:
        return self._count

    @cached_property
    def _count(self) -> int:
        return sum(self._known()) if self._known else self._rows().count()

    @staticmethod
    def source(df: DataFrame) -> IterPipeline:
        """df has a dense _idx."""
        return IterPipeline._own_source(checked(df))

    @staticmethod
    def _own_source(df: DataFrame) -> IterPipeline:
        """As source, of a frame that may hold columns of the engine's."""
        ship(df.sparkSession)
        return _Frame(lambda: df, (), spark=df.sparkSession, note=("source", df))

    @staticmethod
    def mix(inputs: Sequence[IterPipeline] | Mapping[str, IterPipeline], weights=None) -> IterPipeline:
        """The mix that stops at the first input found exhausted.

        Named inputs are mixed in the order of their names, and a state goes by name: a cursor can go on after
        inputs have been added (they begin at their start), taken away or weighted anew.
        """
        if isinstance(inputs, Mapping):
            names = sorted(inputs)
            weights = [weights[k] for k in names] if isinstance(weights, Mapping) else weights
            return _Mixed([inputs[k] for k in names], weights, names)
        return _Mixed(list(inputs), weights)

    @staticmethod
    def interleave(inputs: Sequence[IterPipeline], cycle_length: int, workers: int = 1) -> IterPipeline:
        """Round robin over at most cycle_length open inputs; workers: each interleaves every workers-th input, and their rows are taken in turn."""
        if workers > 1:
            return IterPipeline.interleave([IterPipeline.interleave(inputs[w::workers], cycle_length) for w in range(min(workers, len(inputs)))], workers)
        if cycle_length < 1:
            raise ValueError("cycle_length must be positive")
        inputs = [p._alone() for p in inputs]
        return _Frame(lambda: _interleaved(inputs, cycle_length), tuple(inputs), note=("interleave", cycle_length))

    @staticmethod
    def interleave_parts(df: DataFrame, part: str, parts: int, cycle_length: int) -> IterPipeline:
        """As interleave, of the parts of one frame, which is read once for all of them: the column `part` has their numbers, in [0, parts), and _idx is dense in each."""
        if cycle_length < 1 or parts < 1:
            raise ValueError("cycle_length and parts must be positive")
        ship(df.sparkSession)
        tagged = checked(df).withColumnRenamed(part, "_tw_d")
        sizes = functools.cache(lambda: _sizes(tagged, parts))
        node = _Frame(lambda: _in_turn(tagged, sizes(), cycle_length), (), spark=df.sparkSession, note=("interleave_parts", df, part, parts, cycle_length))
        return node._knowing(lambda: [sum(sizes())])

    @staticmethod
    def zip(inputs: Sequence[IterPipeline], strict: bool = True) -> IterPipeline:
        if not inputs:
            raise ValueError("inputs are needed")
        inputs = [p._alone() for p in inputs]

        def frame():
            if strict and len({p.count() for p in inputs}) > 1:
                raise ValueError("an input is shorter or longer than another")
            out = None
            for i, p in enumerate(inputs):
                df = p.frame()
                part = df.select(IDX, F.struct(*map(quoted, payload(df))).alias(f"_{i + 1}"))
                out = part if out is None else out.join(part, IDX)
            return out

        return _Frame(frame, tuple(inputs), note=("zip", strict))

    def _then(self, f: Callable[[DataFrame], DataFrame], *note) -> IterPipeline:
        return _Frame(lambda: f(self.frame()), (self,), note=note)

    def seed(self, seed: int) -> IterPipeline:
        node = self._then(lambda df: df, "seed", seed)
        node._seed = self._seeded(seed)
        return node

    def map(self, **columns: Column | str) -> IterPipeline:
        made = lambda df: df.select(*own(df), *[as_column(e).alias(k) for k, e in columns.items()])
        node = self._in_order(made, "map", columns) if self._gapped else self._then(made, "map", columns)
        return self._onwards(node, made)._knowing(self.lane_counts)

    def map_with_index(self, f: Callable[[Column], Mapping[str, Column]]) -> IterPipeline:
        made = lambda df: df.select(*own(df), *[e.alias(k) for k, e in f(F.col(IDX)).items()])
        return self._onwards(self._then(made, "map_with_index", f(F.col(IDX))), made)._knowing(self.lane_counts)

    def map_pandas(self, f, schema: str) -> IterPipeline:
        return self._alone()._then(lambda df: df.mapInPandas(lambda it: (f(b) for b in it), f"{IDX} bigint, {schema}"), "map_pandas", f, schema)

    def random_map(self, draw: Callable, returns: str, name: str = "value", inputs: Sequence[str] = (), seed: int | None = None) -> IterPipeline:
        """draw(rng, *inputs): the k-th element of worker w of n draws as element w + k * n; a loader's records draw by their own numbers."""
        node = self._then(None, "random_map", draw, returns, name, inputs, seed)._knowing(self.lane_counts)
        worker, workers, records = self._context
        own_seed = node._seeded(seed) if records is None else None

        def make():
            df = self.frame()
            if records is not None:
                return df.withColumn(name, random_values(F.col(RECORD), records, draw, returns, *map(F.col, inputs), record=True))
            number = F.col(LANE) + F.col(IDX) * self.lanes if self.lanes > 1 else F.col(IDX) * workers + worker
            return df.withColumn(name, random_values(number, own_seed, draw, returns, *map(F.col, inputs)))

        node._make = make
        return node

    def with_options(self, *, filter_warn_above: float | None = None, filter_raise_above: float | None = None) -> IterPipeline:
        """Shares of a window from which filters of the whole plan warn or fail; options given later win."""
        given = tuple((k, v) for k, v in (("warn", filter_warn_above), ("raise", filter_raise_above)) if v is not None)
        node = self._then(None, "with_options", given)

        def make():
            mark = OPTIONS.set(tuple(sorted({**dict(given), **dict(OPTIONS.get())}.items())))
            try:
                return self.frame()
            finally:
                OPTIONS.reset(mark)

        node._make = make
        return node

    def filter(self, condition: Column | str, raise_above: float | None = None, window: int = 1000, warn_above: float | None = None) -> IterPipeline:
        """raise_above, warn_above: fails, or warns, if a full window of inputs loses such a share or more (0 and None: never, and without a job of its own)."""

        keep = F.coalesce(as_column(condition), F.lit(False))
        node = self._in_order(lambda df: df.where(keep), "filter", condition, raise_above, window, warn_above)
        gapped, ranked = node._gapped, node._make

        def shares() -> tuple[float | None, float | None]:
            options = dict(OPTIONS.get())
            return raise_above or options.get("raise"), warn_above or options.get("warn")

        def make():
            fails, warns = shares()
            if not fails and not warns:
                return ranked()
            df = self.frame()  # windows are of the parent's ranks
            most = windows_lost(df, keep, window, self._by).where(F.col("n") == window).agg(F.max("lost")).first()[0] or 0
            said = "the filter drops {:.0%} or more of a window of {} elements"
            if fails and most >= fails * window:
                raise ValueError(said.format(fails, window))
            if warns and most >= warns * window:
                warnings.warn(said.format(warns, window), stacklevel=2)
            return ranked()

        node._make = make
        # A filter that watches its windows does so before one after it goes on from there.
        node._gapped = lambda: (node.frame(), max(self.lane_counts())) if any(shares()) else gapped()
        return node

    def flat_map(self, array: Column | str, name: str = "value", fan_out: int | None = None) -> IterPipeline:
        """fan_out: a record's part has the number record * fan_out + place."""

        def run():
            df, span = self._ordered()
            df = df.withColumn("_tw_a", as_column(array)).where(F.size("_tw_a") > 0)
            df = dense(df, IDX, max(span, 1), F.size("_tw_a"), self._by, self.lanes)
            out = df.select(*[quoted(c) for c in df.columns if c not in ("_tw_a", name)], F.posexplode("_tw_a").alias("_tw_pos", name))
            if RECORD in out.columns:
                out = out.withColumn(RECORD, F.col(RECORD) * fan_out + F.col("_tw_pos")) if fan_out else out.drop(RECORD)
            return out.withColumn(IDX, F.col(IDX) + F.col("_tw_pos")).drop("_tw_pos")

        node = self._then(None, "flat_map", array, name, fan_out)
        node._make = run
        return node

    def limit(self, n: int) -> IterPipeline:
        if n <= 0:
            raise ValueError("count must be positive")
        return self._then(lambda df: df.where(F.col(IDX) < n), "limit", n)._knowing(lambda: [min(n, c) for c in self.lane_counts()])

    def repeat(self, epochs: int) -> IterPipeline:
        if epochs is None or epochs <= 0:
            raise ValueError("epochs must be positive")
        return self._alone()._then(lambda df: _epochs(df, self.count(), 0, self.count() * epochs) if self.count() else df, "repeat", epochs)

    def cache(self) -> IterPipeline:
        return self._then(lambda df: df.persist(), "cache")

    def window_shuffle(self, window: int, seed: int | None = None) -> IterPipeline:
        if window < 1:
            raise ValueError("window must be positive")
        node = self._alone()._then(None, "window_shuffle", window, seed)
        own = node._seeded(seed)

        def make():
            n = self.count()
            tail = n % window
            number = _div(F.col(IDX), window)
            s = F.pmod(F.lit(own).cast("long") + number, F.lit(1 << 32))
            inside = F.pmod(F.col(IDX), F.lit(window))

            # A window is emptied from its end: the p-th row out is perm(m - 1 - p)... so a row goes to m - 1 - inverse.
            size = F.when(number == n // window, tail).otherwise(window) if tail else F.lit(window)
            at = number * window + (size - 1) - permuted(inside, size, s)
            return self.frame().withColumn(IDX, at)

        node._make = make
        return node

    def batch(self, size: int, *, drop_remainder: bool = False, aggregates: Sequence[Column] | None = None, pad: Mapping[str, object] | None = None, function: Callable[[pd.DataFrame], Mapping[str, object]] | None = None, schema: str | None = None, workers: int = 1) -> IterPipeline:
        """As MapPipeline.batch; workers: batches are formed inside each of so many strided parts, then taken in turn."""
        if size < 1:
            raise ValueError("batch size must be positive")
        if workers > 1:
            return self.parallel(workers, lambda part: part.batch(size, drop_remainder=drop_remainder, aggregates=aggregates, pad=pad, function=function, schema=schema))
        form = _form(size, aggregates, pad, function, schema)

        def run(df):
            if drop_remainder:
                df = df.where(F.col(IDX) < self._of_lane([n // size * size for n in self.lane_counts()]))
            return form(df, _div(F.col(IDX), size), F.pmod(F.col(IDX), F.lit(size)), self._by)

        node = self._onwards(self._then(run, "batch", size, drop_remainder, aggregates, pad, function, schema), run, size)
        return node._knowing(lambda: [n // size if drop_remainder else -(-n // size) for n in self.lane_counts()])

    def rebatch(self, size: int, drop_remainder: bool = False) -> IterPipeline:
        if size < 1:
            raise ValueError("batch size must be positive")

        def run(df):
            names = payload(df)
            df = elements = df.select(IDX, *[batching.unstacked(F.col(quoted(c)), df.schema[c].dataType).alias(c) for c in names])
            first = F.size(quoted(names[0]))
            zero = F.when(first < 1, F.raise_error(F.lit("a batch is empty")).cast("int")).otherwise(first)
            df = dense(df.withColumn("_tw_z", zero), IDX, self.count(), F.col("_tw_z")).drop("_tw_z")
            rows = df.select(IDX, F.posexplode(F.arrays_zip(*map(quoted, names))).alias("_tw_pos", "_tw_r")).withColumn(IDX, F.col(IDX) + F.col("_tw_pos")).select(IDX, "_tw_r.*")
            if drop_remainder:
                total = elements.agg(F.sum(F.size(quoted(names[0])))).first()[0] or 0
                rows = rows.where(F.col(IDX) < total // size * size)
            return batching.blocks(rows, _div(F.col(IDX), size), F.pmod(F.col(IDX), F.lit(size)), size)

        return self._alone()._then(run, "rebatch", size, drop_remainder)

    def pack(self, lengths: Mapping[str, int], bins: int, best: bool = False, workers: int = 1, **options) -> IterPipeline:
        """First-fit or best-fit packing of array columns; see operators.packing.pack_bins."""
        return _Pack(self._alone(), lengths, bins, best, workers, options)

    def pack_and_batch(self, lengths: Mapping[str, int], batch_size: int, max_sequences_per_bin: int | None = None) -> IterPipeline:
        """First-fit packing, a whole batch of rows at a time; see operators.packing.pack_and_batch."""
        return self._alone()._then(lambda df: packing.pack_and_batch(df, lengths, batch_size, max_sequences_per_bin), "pack_and_batch", sorted(lengths.items()), batch_size, max_sequences_per_bin)

    def through(self, operation: Callable[[Iterator[dict]], Iterator[dict]], schema: str, workers: int = 1) -> IterPipeline:
        """Elements, in order, through an operation from iterator to iterator.

        The operation may keep state, so one task runs it over sorted rows, which stream; workers: on so many
        strided parts, whose results are taken in turn.
        """
        if workers > 1:
            return self.parallel(workers, lambda part: part.through(operation, schema))

        def run(df):
            names = payload(df)
            kind = T.StructType.fromDDL(schema)
            arrow = to_arrow_schema(T.StructType([T.StructField(IDX, T.LongType()), *kind.fields]))

            def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                elements = (x for b in batches for x in b.select(names).to_pylist())
                numbered = ({**x, IDX: i} for i, x in enumerate(operation(elements)))
                while chunk := list(islice(numbered, 4096)):
                    yield pa.RecordBatch.from_pylist(chunk, schema=arrow)

            return df.repartition(1).sortWithinPartitions(IDX).mapInArrow(each, f"{IDX} bigint, {schema}")

        return self._alone()._then(run, "through", operation, schema, workers)

    def concat_then_split(self, lengths: Mapping[str, int], **options) -> IterPipeline:
        return self._alone()._then(lambda df: packing.concat_then_split(df, lengths, **options), "concat_then_split", sorted(lengths.items()), sorted(options.items(), key=str))

    def parallel(self, workers: int, stage: Callable[[IterPipeline], IterPipeline], sequential: bool = False) -> IterPipeline:
        """Runs a stage on each of `workers` parts and takes their results in turn.

        Parts are strided, or contiguous and even if sequential. They pass through the stage side by side, as lanes
        of one frame; a stage that can't do so is built for each part.
        """
        if workers < 1:
            raise ValueError("workers must be positive")
        if workers == 1:
            return stage(self)
        try:
            return stage(self._alone()._laned(workers, sequential))._merged()
        except NoLanes:
            parts = [self._even(w, workers) if sequential else self.strided(w, workers) for w in range(workers)]
            return IterPipeline.interleave([stage(p) for p in parts], workers)

    def _laned(self, workers: int, sequential: bool) -> IterPipeline:
        def run(df):
            if not sequential:
                return df.withColumns({LANE: F.pmod(F.col(IDX), F.lit(workers)).cast("long"), IDX: _div(F.col(IDX), workers)})
            starts = [schedules.even_split(self.count(), schedules.Shard(w, workers))[0] for w in range(workers)]
            lane = F.size(F.filter(F.lit(starts), lambda x: x <= F.col(IDX))).cast("long") - 1
            return df.withColumn(LANE, lane).withColumn(IDX, F.col(IDX) - F.element_at(F.lit(starts), (F.col(LANE) + 1).cast("int")))

        def counts():
            if sequential:
                return [hi - lo for lo, hi in (schedules.even_split(self.count(), schedules.Shard(w, workers)) for w in range(workers))]
            return [len(range(w, self.count(), workers)) for w in range(workers)]

        node = self._then(run, "lanes", workers, sequential)._knowing(counts)
        node.lanes = workers
        return node

    def _merged(self) -> IterPipeline:
        """The lanes' rows in turn; ended lanes are passed over."""

        def run(df):
            counts = F.lit(self.lane_counts())
            before = F.aggregate(F.transform(counts, lambda c, w: F.least(c.cast("long"), F.col(IDX) + F.when(F.col(LANE) > w, 1).otherwise(0))), F.lit(0).cast("long"), lambda a, x: a + x)
            return df.withColumn(IDX, before).drop(LANE)

        node = self._then(run, "merged")._knowing(lambda: [sum(self.lane_counts())])
        node.lanes = 1
        return node

    def strided(self, first: int, step: int) -> IterPipeline:
        """Every step-th element from the first on: the part of worker `first` of `step`."""
        node = self._alone()._then(lambda df: df.where(F.pmod(F.col(IDX), F.lit(step)) == first).withColumn(IDX, _div(F.col(IDX), step)), "strided", first, step)
        node._context = (first, step, self._context[2])
        return node

    def _even(self, index: int, count: int) -> IterPipeline:
        def run(df):
            lo, hi = schedules.even_split(self.count(), schedules.Shard(index, count))
            return df.where((F.col(IDX) >= lo) & (F.col(IDX) < hi)).withColumn(IDX, F.col(IDX) - lo)

        node = self._then(run, "even", index, count)
        node._context = (index, count, self._context[2])
        return node


class _Frame(IterPipeline):
    def __init__(self, make, parents, note=(), spark=None):
        self._make, self._parents, self.note, self._spark = make, parents, note, spark
        before = [p for p in parents if isinstance(p, IterPipeline)]
        if before:
            self.lanes, self._context = before[0].lanes, before[0]._context

    @property
    def spark(self):
        return self._spark or self._parents[0].spark

    def _frame(self):
        return self._make()


class _Mixed(_Frame):
    """Its snapshot, of named inputs: an index, and by name how many elements each input has given by then and its plan."""

    def __init__(self, inputs, weights, names=None):
        parts = schedules.proportions(weights, len(inputs))
        super().__init__(None, tuple(p._alone() for p in inputs), note=("mix", parts))
        self._parts, self._names, self._at, self._given = parts, names, 0, [0] * len(inputs)

    def signature(self):
        # Named inputs may change across a restore; the snapshot holds the plan of each.
        return super().signature() if self._names is None else hashlib.sha256(b"mix of named inputs").hexdigest()[:16]

    def _ends(self, i: int, count: int) -> int:
        """The position at which an input is asked for a row that it doesn't have."""
        rests = [sum(self._parts[k:]) for k in range(len(self._parts))]
        at = count * rests[i] // self._parts[i]
        for k in range(i - 1, -1, -1):
            free = rests[k] - self._parts[k]
            at = ((at + 1) * rests[k] + free - 1) // free - 1
        return at

    def _from(self, lo: int) -> DataFrame:
        """All elements from lo on; since the snapshot's index each input goes on from what it has given."""
        out, ends = [], []
        for i, p in enumerate(self._parents):
            shift = schedules.taken(self._at, self._parts, i) - self._given[i]
            ends.append(self._ends(i, p.count() + shift))
            rows = p.frame_from(max(0, schedules.taken(max(lo, self._at), self._parts, i) - shift))
            out.append(rows.withColumn(IDX, mix_place(F.col(IDX) + shift, self._parts, i)))
        return reduce(DataFrame.unionByName, out).where(F.col(IDX) < min(ends))

    def _frame(self):
        return self._from(0)

    def frame_from(self, lo):
        return self._from(lo).where(F.col(IDX) >= lo)

    def marks(self, lo):
        if self._names is None:
            return []
        given = [g + schedules.taken(lo, self._parts, i) - schedules.taken(self._at, self._parts, i) for i, g in enumerate(self._given)]
        return [{"index": lo, "inputs": {n: [g, p.signature()] for n, g, p in zip(self._names, given, self._parents, strict=True)}}]

    def resume(self, marks):
        if self._names is None or not marks:
            return
        for i, (name, p) in enumerate(zip(self._names, self._parents, strict=True)):
            given, plan = marks[0]["inputs"].get(name, (0, p.signature()))
            if plan != p.signature():
                raise ValueError(f"the state's input {name} is another pipeline's")
            self._given[i] = given
        self._at = marks[0]["index"]
        self.__dict__.pop("_cached", None)


class _Pack(_Frame):
    """Its snapshot is (row, element): the element begins a batch, before whose first row there are so many rows."""

    def __init__(self, parent, lengths, bins, best, workers, options):
        super().__init__(None, (parent,), note=("pack", sorted(lengths.items()), bins, best, workers, sorted(options.items(), key=str)))
        self._pack = lambda df, **more: packing.pack_bins(df, lengths, bins, best, workers=workers, **options, **more)
        self._borders, self._mark, self._workers = None, None, workers

    def _seen(self, borders: DataFrame) -> None:
        self._borders = borders

    def _frame(self):
        return self._pack(self._parents[0].frame(), borders=self._seen)

    def frame_from(self, lo):
        if not self._mark or self._mark[0] > lo or self._workers > 1:
            return super().frame_from(lo)
        row, element = self._mark
        return self._pack(self._parents[0].frame_from(element), start=(element, row), borders=self._seen).where(F.col(IDX) >= lo)

    def marks(self, lo):
        if self._workers > 1:
            return []
        if self._borders is None:
            self.frame()
        last = self._borders.where(F.col("row") <= lo).agg(F.max(F.struct("row", "element")).alias("m")).first()["m"]
        mark = [last["row"], last["element"]] if last else list(self._mark or (0, 0))
        return [mark, *self._parents[0].marks(mark[1])]

    def resume(self, marks):
        if marks:
            self._mark = tuple(marks[0])
            self._parents[0].resume(marks[1:])


class _ToIter(IterPipeline):
    def __init__(self, parent: MapPipeline, allow_nones: bool):
        if parent.n is None:
            raise ValueError("an endless pipeline needs a limit: repeat(n) or rows(lo, hi)")
        self._parents, self.allow_nones = (parent,), allow_nones

    @cached_property
    def _count(self):
        p = self._parents[0]
        return p.n if not p.sparse or self.allow_nones else self._rows().count()

    def frame_from(self, lo):
        p = self._parents[0]
        return super().frame_from(lo) if p.sparse or not lo else p.rows(lo, p.n)

    def _present(self) -> tuple[DataFrame, int]:
        df = self._parents[0].epoch()
        return (df.where(PRESENT).drop(PRESENT) if PRESENT in df.columns else df), self._parents[0].n

    @property
    def _gapped(self):
        return self._present if self._parents[0].sparse and not self.allow_nones else None

    def _frame(self):
        p = self._parents[0]
        if self._gapped:
            return dense(self._present()[0], IDX, max(p.n, 1))
        df = p.epoch()
        if PRESENT not in df.columns:
            return df
        return df.select(IDX, *[F.when(F.col(PRESENT), F.col(quoted(c))).alias(c) for c in payload(df)])


def _interleaved(inputs: Sequence[IterPipeline], cycle: int) -> DataFrame:
    tagged = reduce(DataFrame.unionByName, [p.frame().withColumn("_tw_d", F.lit(i).cast("long")) for i, p in enumerate(inputs)])
    counts = [p.count() for p in inputs] if all("_count" in p.__dict__ for p in inputs) else _sizes(tagged, len(inputs))
    return _in_turn(tagged, counts, cycle)


def _sizes(tagged: DataFrame, inputs: int) -> list[int]:
    found = dict(tagged.groupBy("_tw_d").agg(F.count(F.lit(1))).collect())  # one row for each input
    return [found.get(i, 0) for i in range(inputs)]


def _in_turn(tagged: DataFrame, counts: Sequence[int], cycle: int) -> DataFrame:
    """Rows of inputs that _tw_d numbers, at their places in the round robin."""
    if cycle >= len(counts):
        # All inputs are open from the start: row j of input i comes after every row of earlier turns, and
        # after those of earlier slots in turn j. Turns are numbered by row; sums of what is left give places.
        before = F.aggregate(F.transform(F.lit(counts), lambda c, d: F.least(c.cast("long"), F.col(IDX) + F.when(F.col("_tw_d") > d, 1).otherwise(0))), F.lit(0).cast("long"), lambda a, x: a + x)
        return tagged.withColumn(IDX, before).drop("_tw_d")
    runs = schedules.interleave_runs(counts, cycle)
    table = tagged.sparkSession.createDataFrame(pd.DataFrame(runs, columns=["_tw_d", "_tw_lo", "_tw_n", "_tw_at", "_tw_by"]), "_tw_d long, _tw_lo long, _tw_n long, _tw_at long, _tw_by long")
    table = F.broadcast(table) if len(runs) <= 1_000_000 else table
    off = F.col(IDX) - F.col("_tw_lo")
    inside = (tagged["_tw_d"] == table["_tw_d"]) & (off >= 0) & (off < F.col("_tw_n"))
    return tagged.join(table, inside).withColumn(IDX, F.col("_tw_at") + off * F.col("_tw_by")).drop("_tw_d", "_tw_lo", "_tw_n", "_tw_at", "_tw_by")


def elastic_batches(ds: MapPipeline, global_batch: int, shard: schedules.Shard, next_index: int = 0) -> IterPipeline:
    """A host's batches from a global position on; any shard layout can resume there. The remainder is dropped."""
    if ds.sparse:
        raise ValueError("elements may be absent: filter after batching")
    if global_batch % shard.count:
        raise ValueError("the global batch must be a multiple of the shard count")
    steps = max(ds.n - next_index, 0) // global_batch
    df = ds.rows(next_index, next_index + steps * global_batch)
    off = F.col("_idx") - next_index
    own = df.where(F.pmod(off, F.lit(shard.count)) == shard.index).withColumn("_idx", _div(off, shard.count))
    return IterPipeline.source(own).batch(global_batch // shard.count)
