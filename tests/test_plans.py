"""Plans: filters in a row, signatures, columns of any name, mixes of any weights."""

import functools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.cursor import Cursor
from tidewheel.pipeline import IterPipeline, MapPipeline, mix_place


@pytest.fixture(scope="module")
def ds(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("source"))
    spark.range(1000).select(F.col("id").alias("_idx"), (F.col("id") * 7 % 1000).alias("value")).write.mode("overwrite").parquet(path)
    return MapPipeline.source(spark.read.parquet(path), 1000)


def scans(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def chain(ds, n):
    for k in range(n):
        ds = ds.filter(F.col("value") % (k + 2) != 0).map(value="value", more="value + 1")
    return ds


@pytest.mark.parametrize("start", ["source", "absent"])
def test_filters_in_a_row_scan_no_more_than_one(ds, start):
    begin = ds.to_iter() if start == "source" else ds.filter("value <> 5").to_iter()
    one, five = chain(begin, 1), chain(begin, 5)
    assert scans(five.frame()) == scans(one.frame()) == 2
    want = [v for v in (k * 7 % 1000 for k in range(1000)) if (start == "source" or v != 5) and all(v % m for m in range(2, 7))]
    got = sorted((r["_idx"], r["value"], r["more"]) for r in five.frame().collect())
    assert got == [(i, v, v + 1) for i, v in enumerate(want)] and five.count() == len(want)
    parts = five.flat_map(F.array_repeat("value", 2), "part")
    assert scans(parts.frame()) == 2 and [r["part"] for r in parts.frame().orderBy("_idx").collect()] == [v for v in want for _ in range(2)]
    laned = begin.parallel(3, lambda part: chain(part, 2))
    own = [[v for v in (r["value"] for r in begin.frame().orderBy("_idx").collect()[w::3]) if v % 2 and v % 3] for w in range(3)]
    assert [r["value"] for r in laned.frame().orderBy("_idx").collect()] == [p[k] for k in range(max(map(len, own))) for p in own if k < len(p)]


SCALE = 2


def by_global(i):
    return {"value": i * SCALE}


class Adds:
    def __init__(self, n):
        self.n = n

    def __call__(self, i):
        return {"value": i + self.n}


def other():
    def named(g, n):
        return int(g.integers(0, n)) + 1

    return named


def named(g, n):
    return int(g.integers(0, n))


def test_signatures_tell_plans_apart(ds, monkeypatch):
    def closing(a):
        return lambda g: int(a[g.integers(0, len(a))])

    a = np.zeros(5000, np.int64)
    b = a.copy()
    b[2500] = 1
    draw = lambda f: ds.random_map(f, "long", seed=1).signature()
    assert draw(closing(a)) == draw(closing(a.copy())) != draw(closing(b))
    assert draw(functools.partial(named, n=5)) == draw(functools.partial(named, n=5))
    assert len({draw(functools.partial(f, n=n)) for f in (named, other()) for n in (5, 6)}) == 4
    frame = lambda g: ds.to_iter().through(g, "value long").signature()
    through = lambda it: (dict(x, value=x["value"] * SCALE) for x in it)
    before = frame(through)
    monkeypatch.setitem(globals(), "SCALE", 3)
    assert frame(through) != before
    assert frame(Adds(1)) == frame(Adds(1)) != frame(Adds(2)) and frame(Adds(1).__call__) != frame(Adds(2).__call__)
    udf = lambda n: F.pandas_udf(lambda s: s + n, "long")
    told = lambda n: ds.map(value=udf(n)("value")).signature()
    assert told(1) != told(2)
    with pytest.raises(ValueError):
        frame(iter([1]))


def test_states_of_other_functions_are_refused(ds):
    one, two = (Cursor(ds.to_iter().through(Adds(n), "value long")) for n in (1, 2))
    with pytest.raises(ValueError):
        two.set_state(one.get_state())


ANY = ["_tw_s", "_tw_b", "_tw_in", "a.b", "c`d", "Ä x", "value"]


def test_columns_of_any_name(spark):
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    df = spark.range(40).select(F.col("id").alias("_idx"), *[(F.col("id") + k).alias(c) for k, c in enumerate(ANY)])
    ds = MapPipeline.source(df, 40)
    it = ds.to_iter().filter(F.col("value") % 2 == 0)
    assert set(it.frame().columns) == {"_idx", *ANY}
    assert sorted(r["_tw_s"] for r in it.frame().collect()) == list(range(0, 40, 2))
    batches = it.batch(4).frame().orderBy("_idx").collect()
    assert batches[1]["a.b"] == [r + 3 for r in (8, 10, 12, 14)] and batches[1]["c`d"] == [r + 4 for r in (8, 10, 12, 14)]
    assert [r["a.b"] for r in it.batch(4).rebatch(7).frame().orderBy("_idx").collect()][0] == [r + 3 for r in range(0, 14, 2)]
    zipped = MapPipeline.zip([ds, ds[::-1]]).epoch().orderBy("_idx").first()
    assert zipped["_1"]["a.b"] == 3 and zipped["_2"]["a.b"] == 42
    assert ds[3]["c`d"] == 7 and set(ds.flat_map(F.array("value"), 1, "part").epoch().columns) == {"_idx", "_present", "part", *ANY}
    odd = it.batch(3, function=lambda b: {"s": int(b["a.b"].sum())}, schema="s long").frame().orderBy("_idx").first()
    assert odd["s"] == 3 + 5 + 7
    for name in ("_lane", "_record", "_present"):
        with pytest.raises(ValueError):
            MapPipeline.source(df.withColumn(name, F.lit(1)), 40)
        with pytest.raises(ValueError):
            IterPipeline.source(df.withColumn(name, F.lit(1)))


def test_mixes_of_far_weights_stay_in_whole_numbers(spark):
    parts = [10**11, 100]
    rests = [sum(parts), parts[1]]
    for which, js in ((0, [0, 1, 2 * 10**9]), (1, [0, 1, 2_000, 10**6])):
        got = [r[0] for r in spark.createDataFrame([(j,) for j in js], "j long").select(mix_place(F.col("j"), parts, which)).collect()]
        want = [j * rests[0] // parts[0] if which == 0 else ((j * rests[1] // parts[1] + 1) * rests[0] + rests[0] - parts[0] - 1) // (rests[0] - parts[0]) - 1 for j in js]
        assert got == want


def test_named_mixes_go_on_with_other_inputs(spark):
    from tidewheel.functions.schedules import proportions, taken

    def loop(inputs, weights, at, given):
        """Elements from `at` on, one after the other, until an input is asked for what it hasn't."""
        names = sorted(inputs)
        parts, out, k = proportions([weights[n] for n in names], len(names)), [], at
        given = {n: given.get(n, 0) for n in names}
        while True:
            i = next(i for i in range(len(names)) if taken(k + 1, parts, i) > taken(k, parts, i))
            if given[names[i]] == len(inputs[names[i]]):
                return out, given
            out.append(inputs[names[i]][given[names[i]]])
            given[names[i]] += 1
            k += 1

    def mixed(inputs, weights):
        return IterPipeline.mix({n: MapPipeline.range(spark, r.start, r.stop).to_iter() for n, r in inputs.items()}, weights)

    first = {"b": range(100, 160), "a": range(0, 50), "c": range(200, 230)}
    cursor = Cursor(mixed(first, {"a": 1.0, "b": 2.0, "c": 0.5}))
    head = [next(cursor)["value"] for _ in range(23)]
    want, _ = loop(first, {"a": 1.0, "b": 2.0, "c": 0.5}, 0, {})
    assert head == want[:23]
    state = cursor.get_state()
    given = {n: sum(r.start <= x < r.stop for x in head) for n, r in first.items()}
    assert {n: g for n, (g, _) in state["marks"][0]["inputs"].items()} == given
    same = Cursor(mixed(first, {"a": 1.0, "b": 2.0, "c": 0.5}))
    same.set_state(state)
    assert [r["value"] for r in same] == want[23:]
    for inputs, weights in (({"a": first["a"], "b": first["b"], "d": range(300, 340)}, {"a": 1.0, "b": 1.0, "d": 3.0}), ({"b": first["b"]}, {"b": 1.0}), (first, {"a": 5.0, "b": 1.0, "c": 1.0})):
        other = Cursor(mixed(inputs, weights))
        other.set_state(state)
        wanted, _ = loop(inputs, weights, 23, given)
        assert [next(other)["value"] for _ in range(5)] == wanted[:5]
        again = Cursor(mixed(inputs, weights))
        again.set_state(other.get_state())
        assert [r["value"] for r in again] == wanted[5:]
    changed = Cursor(mixed({**first, "a": range(1, 50)}, {"a": 1.0, "b": 2.0, "c": 0.5}))
    with pytest.raises(ValueError):
        changed.set_state(state)


def test_samplers_of_the_user(spark):
    import types
    from tidewheel.functions.schedules import Shard
    from tidewheel.loader import CustomSampler, DataLoader

    class Squares:
        """A sampler without a length."""

        def __getitem__(self, i):
            if i >= 37:
                raise IndexError
            return i * i % 50

    class Keyed:
        def __len__(self):
            return 20

        def __getitem__(self, i):
            return types.SimpleNamespace(index=i, record_key=i * i % 50)

    source = spark.range(50).select(F.col("id").alias("_idx"), (F.col("id") * 10).alias("value"))
    for sampler, n in ((Squares(), 37), (Keyed(), 20)):
        own = CustomSampler(sampler)
        assert len(own) == n
        assert [r["value"] for r in DataLoader(source, own)] == [i * i % 50 * 10 for i in range(n)]
        part = DataLoader(source, CustomSampler(sampler, Shard(1, 3)), worker_count=2)
        assert [r["value"] for r in part] == [i * i % 50 * 10 for i in range(1, n, 3)]
    state = iter(DataLoader(source, CustomSampler(Squares()))).get_state()
    with pytest.raises(ValueError):
        iter(DataLoader(source, CustomSampler(Keyed()))).set_state(state)
    with pytest.raises(IndexError):
        CustomSampler(Keyed()).keys(spark, 0, 21)
