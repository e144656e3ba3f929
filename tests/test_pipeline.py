"""Pipelines on small ranges: known orders, errors, restores, and independence from partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.cursor import Cursor, ElasticCursor, assert_equal_after_restore
from tidewheel.functions.permutation import permute
from tidewheel.functions.schedules import Shard, default_seed, element_generators
from tidewheel.functions.stats import PerformanceConfig, pick_performance_config
from tidewheel.loader import DataLoader, IndexSampler, SequentialSampler, elastic_batches, load
from tidewheel.operators.packing import padding_ratio
from tidewheel.operators.transforms import Batch, Filter, Map, RandomMap
from tidewheel.pipeline import IterPipeline, MapPipeline
from tidewheel.plans.ranking import indexed
from tidewheel.sources import tfrecord
from tidewheel.sources.tables import in_memory, iterate_parquet
from tidewheel.streaming.index_stream import stream


def values(df, column="value"):
    return [r[column] for r in df.orderBy("_idx").collect()]


def lists(spark, sizes):
    return [IterPipeline.source(spark.createDataFrame([(i, k) for i in range(n)], "_idx long, value long")) for k, n in enumerate(sizes, 1)]


def test_shuffle_and_mix(spark):
    assert values(MapPipeline.range(spark, 10).seed(42).shuffle().epoch()) == [1, 7, 6, 9, 0, 8, 4, 5, 3, 2]
    evens, odds = MapPipeline.range(spark, 0, 10, 2), MapPipeline.range(spark, 1, 10, 2)
    assert values(MapPipeline.mix([evens, odds], [0.75, 0.25]).repeat(2).epoch()) == [0, 2, 4, 1, 6, 8, 0, 3, 2, 4, 6, 5]
    assert values(MapPipeline.mix([evens, odds], [1, 2]).repeat(2).epoch()) == [0, 1, 3, 2, 5, 7, 4, 9, 1, 6, 3, 5, 8, 7]
    a, b = MapPipeline.range(spark, 15), MapPipeline.range(spark, 100, 115)
    assert IterPipeline.mix([a.to_iter(), b.to_iter()], [1, 2]).count() == MapPipeline.mix([a, b], [1, 2]).n + 1


def test_interleave_of_one_frames_parts(spark):
    for sizes in ([1, 2, 3, 4, 5], [3, 0, 5, 0], [2]):
        df = spark.createDataFrame([(i, k, 10 * k + i) for k, n in enumerate(sizes) for i in range(n)], "_idx long, part int, value long").repartition(3)
        inputs = [IterPipeline.source(df.where(f"part = {k}").drop("part")) for k in range(len(sizes))]
        for cycle in (1, 2, 5):
            parts = IterPipeline.interleave_parts(df, "part", len(sizes), cycle)
            assert parts.count() == sum(sizes) and values(parts.frame()) == values(IterPipeline.interleave(inputs, cycle).frame())
            assert parts.frame().columns == ["_idx", "value"]
    with pytest.raises(ValueError):
        IterPipeline.interleave_parts(df, "part", 1, 0)


def test_windows_of_rows_that_come_mixed(spark):
    """Rows of all windows in each batch, and a short last window."""
    n = 10_037
    df = spark.range(n).select(F.pmod(F.col("id") * 4001, F.lit(n)).alias("_idx")).withColumn("value", F.col("_idx"))
    straight, turned = [], []
    for w, lo in enumerate(range(0, n, 100)):
        own = [lo + int(v) for v in permute(np.arange(min(100, n - lo)), min(100, n - lo), 7 + w)]
        straight += own
        turned += own[::-1]
    assert values(IterPipeline.source(df).window_shuffle(100, 7).frame()) == turned
    assert values(MapPipeline.source(df, n).window_shuffle(100, 7, clip_last=True).epoch()) == straight


def test_interleave(spark):
    assert values(IterPipeline.interleave(lists(spark, [1, 2, 3, 4, 5]), 3).frame()) == [1, 2, 3, 2, 3, 4, 3, 4, 5, 4, 5, 4, 5, 5, 5]
    assert values(IterPipeline.interleave(lists(spark, [1, 2, 3, 4, 5]), 5, workers=3).frame()) == [1, 2, 3, 4, 5, 3, 4, 2, 3, 4, 5, 4, 5, 5, 5]


def test_window_shuffle(spark):
    rows = spark.createDataFrame(list(enumerate("1a 2a 1b 2b 1c 2c 1d 2d".split())), "_idx long, value string")
    assert values(IterPipeline.source(rows).window_shuffle(3, 42).frame()) == "1b 2a 1a 1c 2b 2c 2d 1d".split()


def test_batches_and_loader(spark):
    assert values(MapPipeline.range(spark, 1, 5).batch(3, pad={"value": 0}).epoch()) == [[1, 2, 3], [4, 0, 0]]
    assert values(IterPipeline.source(MapPipeline.range(spark, 7).batch(2).epoch()).rebatch(3).frame()) == [[0, 1, 2], [3, 4, 5], [6]]
    source = spark.range(8).select(F.col("id").alias("_idx"), F.col("id").alias("value"))
    for workers in (0, 2):
        loader = DataLoader(source, SequentialSampler(8), [Map({"value": "value + 1"}), Filter("value % 2 = 0"), Batch(2)], workers)
        assert [r.value for r in loader] == [[2, 4], [6, 8]]
    assert values(elastic_batches(MapPipeline.range(spark, 10).map(value="value + 1"), 8, Shard(2, 4)).frame()) == [[3, 7]]


def test_packing(spark):
    df = spark.createDataFrame([(0, [1] * 4, 7), (1, [2] * 8, 8), (2, [3] * 2, 9)], "_idx long, f array<long>, tag long")
    rows = IterPipeline.source(df).pack({"f": 10}, 2, best=True, shuffle_bins=False, meta=("tag",)).frame().orderBy("_idx").collect()
    assert [r.f for r in rows] == [[1] * 4 + [0] * 6, [2] * 8 + [3] * 2] and [r.tag for r in rows] == [[7], [8, 9]]
    assert rows[1].f_segment_ids == [1] * 8 + [2] * 2 and rows[1].f_positions == [*range(8), 0, 1]
    cut = IterPipeline.source(df.drop("tag")).concat_then_split({"f": 6}, bos={"f": -1}).frame().orderBy("_idx").collect()
    assert [r.f for r in cut] == [[-1, 1, 1, 1, -1, 2], [-1, 2, 2, 2, 2, 2], [-1, 3, 0, 0, 0, 0]]


def test_restore_and_errors(spark, tmp_path):
    ds = MapPipeline.range(spark, 5).seed(1).shuffle().to_iter().batch(2)
    assert_equal_after_restore(ds)
    cursor = Cursor(ds)
    next(cursor)
    cursor.save(str(tmp_path))
    other = Cursor(ds)
    other.load(str(tmp_path))
    assert list(other) == list(cursor)
    with pytest.raises(ValueError):
        Cursor(MapPipeline.range(spark, 6).to_iter()).load(str(tmp_path))
    ten = MapPipeline.range(spark, 10)
    for bad in (lambda: ten.shuffle(), lambda: ten.batch(0), lambda: ten.filter("value > 1").batch(2), lambda: ten.repeat(0), lambda: MapPipeline.mix([ten, ten], [0, 1]), lambda: MapPipeline.zip([ten, ten[:3]]), lambda: ten.to_iter().limit(0), lambda: Shard(2, 2), lambda: MapPipeline.concatenate([ten.repeat()])):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(IndexError):
        SequentialSampler(4).keys(spark, 0, 5)
    with pytest.raises(ValueError):
        IndexSampler(4, shuffle=True)


def test_tfrecords(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"".join(map(tfrecord.frame, [b"1", b"", b"2 1"])))
    rows = tfrecord.read_tfrecords(spark, str(tmp_path / "a")).orderBy("offset").collect()
    assert [bytes(r.record) for r in rows] == [b"1", b"", b"2 1"]
    for seen, left in ((0, [b"", b"2 1"]), (1, [b"2 1"]), (2, [])):
        again = tfrecord.read_tfrecords(spark, str(tmp_path / "a"), {rows[seen].path: rows[seen].offset}).orderBy("offset").collect()
        assert [bytes(r.record) for r in again] == left
    with pytest.raises(ValueError):
        list(tfrecord.frames(b"\1"))


def test_pack_and_batch(spark):
    df = spark.createDataFrame([(0, [1, 1, 1], [9]), (1, [2, 2], [8, 8, 8]), (2, [3], [7, 7])], "_idx long, inputs array<long>, targets array<long>")
    got = IterPipeline.source(df).pack_and_batch({"inputs": 3, "targets": 4}, 2).frame().orderBy("_idx").collect()
    assert [(r["inputs"], r["targets_segment_ids"], r["inputs_positions"], r["last_index"]) for r in got] == [
        ([[1, 1, 1], [2, 2, 0]], [[1, 0, 0, 0], [1, 1, 1, 0]], [[0, 1, 2], [0, 1, 0]], 1),
        ([[3, 0, 0], [0, 0, 0]], [[1, 1, 0, 0], [0, 0, 0, 0]], [[0, 0, 0], [0, 0, 0]], 2)]
    assert IterPipeline.source(df.limit(0)).pack_and_batch({"inputs": 3, "targets": 4}, 2).frame().isEmpty()


def test_features_of_vectors_are_packed(spark):
    df = spark.createDataFrame([(0, [[1, 2], [3, 4]]), (1, []), (2, [[5, 6]])], "_idx long, v array<array<long>>")
    packed = IterPipeline.source(df).pack({"v": 4}, 1, shuffle_bins=False).frame().first()
    assert packed["v"] == [[1, 2], [3, 4], [5, 6], [0, 0]] and packed["v_positions"] == [0, 1, 0, 0]
    batch = IterPipeline.source(df).pack_and_batch({"v": 2}, 3).frame().first()
    assert batch["v"] == [[[1, 2], [3, 4]], [[5, 6], [0, 0]], [[0, 0], [0, 0]]]


def test_operations_from_iterator_to_iterator(spark):
    def pairs(elements):
        for x in elements:
            yield {"both": x["value"] + next(elements)["value"]}

    ds = MapPipeline.range(spark, 12).to_iter()
    assert values(ds.through(pairs, "both long").frame(), "both") == [1, 5, 9, 13, 17, 21]
    assert values(ds.through(pairs, "both long", workers=2).frame(), "both") == [2, 4, 10, 12, 18, 20]


def test_filter_warns(spark):
    ds = MapPipeline.range(spark, 2000).to_iter()
    with pytest.warns(UserWarning, match="90%"):
        assert ds.filter("value >= 950", warn_above=0.9).count() == 1050


def test_workers_draw_numbers_of_their_own(spark):
    """The k-th element of worker w of n has the generator of element w + k * n."""
    draw = lambda g: int(g.integers(0, 1 << 40))
    pool = element_generators(default_seed([(41, 1)]))
    alone = [int(pool(i).integers(0, 1 << 40)) for i in range(12)]
    ds = MapPipeline.range(spark, 12).to_iter().seed(41)
    for workers in (1, 2, 3):
        got = ds.parallel(workers, lambda p: p.random_map(draw, "long", "drawn", seed=default_seed([(41, 1)])))
        assert values(got.frame(), "drawn") == alone and len(set(alone)) == 12
    # After a filter each worker counts its own elements; a stage that can't run side by side gives the same.
    def stage(apart):
        def f(p):
            p = p.filter("value % 3 <> 1")
            return (p.rebatch_free() if apart else p).random_map(draw, "long", "drawn", seed=7)
        return f

    IterPipeline.rebatch_free = lambda self: self._alone()
    together, apart = (values(ds.parallel(2, stage(x)).frame(), "drawn") for x in (False, True))
    pool = element_generators(7)
    first, second = [0, 2, 6, 8], [3, 5, 9, 11]
    want = [int(pool(w + 2 * k).integers(0, 1 << 40)) for k in range(4) for w in range(2)]
    assert together == apart == want and values(ds.parallel(2, lambda p: p.filter("value % 3 <> 1")).frame()) == [x for pair in zip(first, second, strict=True) for x in pair]


def test_loaders_draw_by_record(spark):
    source = spark.range(8).select(F.col("id").alias("_idx"), F.col("id").alias("value"))
    draws = RandomMap(lambda g, x: int(x * 1000 + g.integers(0, 1000)), "long", "drawn", ("value",))
    for workers in (0, 2, 3):
        loader = DataLoader(source, IndexSampler(8, num_epochs=2, shuffle=True, seed=3), [Filter("value <> 5"), draws], workers)
        rows = loader.pipeline().frame().drop("_idx").collect()
        keys = {r["_index"]: r["_record_key"] for r in loader.sampler.keys(spark, 0, 16).collect()}
        want = sorted(k * 1000 + int(np.random.Generator(np.random.Philox(key=3 + i)).integers(0, 1000)) for i, k in keys.items() if k != 5)
        assert sorted(r.drawn for r in rows) == want


def test_parts_side_by_side_and_one_by_one(spark):
    ds = MapPipeline.range(spark, 23).to_iter()
    stages = {
        "batch": lambda p: p.filter("value % 5 > 0").batch(3), "drop": lambda p: p.batch(4, drop_remainder=True),
        "parts": lambda p: p.flat_map("sequence(0, value % 3)", "x").limit(9), "index": lambda p: p.map_with_index(lambda i: {"x": i * 100 + F.col("value")}), "sums": lambda p: p.batch(3, aggregates=[F.sum("value").alias("x")])}
    for name, stage in stages.items():
        for sequential in (False, True):
            for workers in (2, 4):
                column = "value" if name in ("batch", "drop") else "x"
                parts = [ds._even(w, workers) if sequential else ds.strided(w, workers) for w in range(workers)]
                want = values(IterPipeline.interleave([stage(p) for p in parts], workers).frame(), column)
                assert values(ds.parallel(workers, stage, sequential).frame(), column) == want, name
    assert [x for b in values(ds.parallel(2, lambda p: p.batch(4), sequential=True).frame())[::2] for x in b] == list(range(12))


def test_batches_by_functions(spark):
    half = lambda b: {"total": int(b["value"].sum()), "first": int(b["value"].iloc[0])}
    got = MapPipeline.range(spark, 7)[::-1].batch(3, function=half, schema="total long, first long").epoch().orderBy("_idx").collect()
    assert [(r.total, r.first) for r in got] == [(15, 6), (6, 3), (0, 0)]
    together = MapPipeline.range(spark, 7).to_iter().batch(2, function=half, schema="total long, first long", workers=2).frame()
    assert values(together, "total") == [2, 4, 10, 5]
    with pytest.raises(ValueError):
        MapPipeline.range(spark, 7).batch(3, function=half)


def test_null_elements_are_dropped(spark):
    ds = MapPipeline.range(spark, 6).map_or_drop(value="IF(value % 2 = 0, value, NULL)")
    assert len(ds) == 6 and values(ds.to_iter().frame()) == [0, 2, 4] and ds[1] is None
    assert values(ds.to_iter(allow_nones=True).frame()) == [0, None, 2, None, 4, None]
    with pytest.raises(ValueError):
        ds.batch(2)


def test_flat_map_of_random_access(spark):
    ds = MapPipeline.range(spark, 1, 4).flat_map("sequence(1, value)", 3, "x")
    assert len(ds) == 9 and [(r["_idx"], r.x) for r in ds.epoch().orderBy("_idx").collect()] == [(0, 1), (3, 1), (4, 2), (6, 1), (7, 2), (8, 3)]
    with pytest.raises(Exception, match="more than 2 parts"):
        MapPipeline.range(spark, 1, 4).flat_map("sequence(1, value)", 2, "x").epoch().collect()


def test_window_shuffle_reaches_into_the_next_epoch(spark):
    got = values(MapPipeline.range(spark, 8).window_shuffle(3, 42).epoch())
    want = []
    for i in range(8):
        w = i // 3
        want.append((w * 3 + int(permute([i % 3], 3, 42 + w)[0])) % 8)
    assert got == want


def test_repeat_without_reseeding(spark):
    ds = MapPipeline.range(spark, 10).seed(42).shuffle()
    once = [1, 7, 6, 9, 0, 8, 4, 5, 3, 2]
    assert values(ds.repeat(2, reseed_each_epoch=False).epoch()) == once * 2
    assert values(ds.repeat(2).epoch()) != once * 2


def test_frames_of_selections(spark):
    a, b = MapPipeline.range(spark, 5), MapPipeline.range(spark, 100, 105)
    pairs = [(1, 4), (0, 0), (0, 3), (1, 0), (0, 3)]
    frame = spark.createDataFrame([(i, d, k) for i, (d, k) in enumerate(pairs)], "_idx long, input int, index long")
    for selection in (pairs, frame):
        assert values(MapPipeline.select_from([a, b], selection).epoch()) == [104, 0, 3, 100, 3]


def test_options_of_a_plan(spark):
    ds = MapPipeline.range(spark, 2000).to_iter().filter("value >= 950").map(value="value + 1")
    with pytest.warns(UserWarning, match="90%"):
        assert ds.with_options(filter_warn_above=0.9).count() == 1050
    with pytest.raises(ValueError):
        ds.with_options(filter_raise_above=0.99).with_options(filter_raise_above=0.9).count()
    assert ds.with_options(filter_raise_above=0.9).with_options(filter_raise_above=0.99).count() == 1050


def test_parquet_files_in_turn(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for k, n in enumerate((4, 4, 2)):
        pq.write_table(pa.table({"text": [f"{k}{chr(97 + i)}" for i in range(n)]}), tmp_path / f"{k}.parquet", row_group_size=2)
    paths = [str(tmp_path / f"{k}.parquet") for k in range(3)]
    assert values(iterate_parquet(spark, paths[0]).frame(), "text") == "0a 0b 0c 0d".split()
    assert values(iterate_parquet(spark, paths).frame(), "text") == "0a 1a 2a 0b 1b 2b 0c 1c 0d 1d".split()
    assert values(iterate_parquet(spark, paths, cycle_length=2).frame(), "text") == "0a 1a 0b 1b 0c 1c 0d 1d 2a 2b".split()
    assert values(iterate_parquet(spark, paths, shard=Shard(0, 2)).frame(), "text") == "0a 2a 0b 2b 0c 0d".split()
    for bad in ([], paths[:1]):
        with pytest.raises(ValueError):
            iterate_parquet(spark, bad, shard=Shard(1, 2))
    assert values(IterPipeline.source(in_memory(spark, [3, None, 5], "three")).frame()) == [3, None, 5] and spark.table("three").count() == 3


def test_parquet_folder_is_one_order(spark, tmp_path):
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from tidewheel import catalogue

    (tmp_path / "orders.parquet").mkdir()
    parts = [[5, 9, 1, 5], [], [8, 2, 9], [7, 5]]
    for k, keys in enumerate(parts):
        pq.write_table(pa.table({"o_orderkey": pa.array(keys, pa.int64()), "a.b": pa.array(keys, pa.int64())}), tmp_path / f"orders.parquet/part-{k}.parquet", row_group_size=2)
    keys = sum(parts, [])
    for path in (tmp_path / "orders.parquet", tmp_path / "orders.parquet/*.parquet"):
        frame = iterate_parquet(spark, str(path)).frame()
        assert sorted((r["_idx"], r["o_orderkey"], r["a.b"]) for r in frame.collect()) == [(i, k, k) for i, k in enumerate(keys)]
    got = sorted(tuple(r) for r in catalogue.queries()["src_parquet_files"](spark, str(tmp_path)).collect())
    order = sorted(range(len(keys)), key=lambda i: (-keys[i], i))
    assert got == [(n, keys[i], i) for n, i in enumerate(order)]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    assert got == sorted(con.execute(catalogue.oracle_sql()["src_parquet_files"]).fetchall())



def test_dense_indices(spark):
    rows = [(k, str(k % 3)) for k in (5, 100, -7, 3, 12)]
    df = spark.createDataFrame(rows, "k long, s string")
    for order, want in (("k", [-7, 3, 5, 12, 100]), (F.col("k").desc(), [100, 12, 5, 3, -7])):
        out, n = indexed(df, order)
        assert n == 5 and values(out, "k") == want
    out, n = indexed(df, "s", F.col("k").desc())
    assert n == 5 and values(out, "k") == [12, 3, 100, 5, -7] and indexed(df.limit(0), "k")[1] == 0
    lopsided = spark.range(300_000).withColumn("id", F.when(F.col("id") == 0, 1 << 40).otherwise(F.col("id")))
    out, n = indexed(lopsided, "id")  # nearly all keys in one bucket: ranked by partitions
    assert n == 300_000 and out.agg(F.min("_idx"), F.max("_idx"), F.countDistinct("_idx")).first()[:] == (0, 299_999, 300_000)
    assert out.where(f"id = {1 << 40}").first()["_idx"] == 299_999


def test_plans_have_signatures_of_their_own(spark, tmp_path):
    for k in (1, 2):
        spark.range(5).write.parquet(str(tmp_path / str(k)))
    one, two = (MapPipeline.source(spark.read.parquet(str(tmp_path / str(k))).withColumnRenamed("id", "_idx").withColumn("value", F.col("_idx")), 5) for k in (1, 2))
    plus = lambda n: lambda i: {"value": i + n}
    draws = lambda n: lambda g: int(g.integers(0, n))
    plans = [one, two, one.map_with_index(plus(1)), one.map_with_index(plus(2)), one.random_map(draws(5), "int", seed=1), one.random_map(draws(6), "int", seed=1), one.batch(2), one.batch(3)]
    plans += [p.to_iter() for p in plans[:3]] + [one.to_iter().filter("value > 1"), one.to_iter().filter("value > 2"), one.to_iter().through(lambda it: it, "value long"), one.to_iter().through(lambda it: (x for x in it), "value long")]
    assert len({p.signature() for p in plans}) == len(plans)
    again = MapPipeline.source(spark.read.parquet(str(tmp_path / "1")).withColumnRenamed("id", "_idx").withColumn("value", F.col("_idx")), 5)
    assert again.map_with_index(plus(1)).signature() == plans[2].signature()


def test_hosts_go_on_in_any_layout(spark, tmp_path):
    ds = MapPipeline.range(spark, 40).seed(3).shuffle()
    order = values(ds.epoch())
    two = [ElasticCursor(ds, 8, Shard(s, 2)) for s in range(2)]
    seen = [x for _ in range(2) for c in two for x in next(c).value]
    for c in two:
        c.save(str(tmp_path))
    four = [ElasticCursor(ds, 8, Shard(s, 4)) for s in range(4)]
    for c in four:
        c.load(str(tmp_path))
    seen += [x for c in four for r in c for x in r.value]
    assert sorted(seen) == sorted(order) and sorted(seen[:16]) == sorted(order[:16])
    with pytest.raises(ValueError):
        ElasticCursor(ds[:20], 8, Shard(0, 2)).load(str(tmp_path))
    with pytest.raises(ValueError):
        ElasticCursor(ds, 8, Shard(0, 2)).load(str(tmp_path / "none"))
    next(two[0])
    two[0].save(str(tmp_path))  # one host of two alone: the last whole set counts
    four[0].load(str(tmp_path))
    assert four[0].get_state()["global_next_index"] == 16
    next(two[1])
    two[1].save(str(tmp_path))
    four[0].load(str(tmp_path))
    assert four[0].get_state()["global_next_index"] == 24
    one = ElasticCursor(ds, 8, Shard(0, 1))
    one.load(str(tmp_path))
    next(one)
    one.save(str(tmp_path))  # by fewer hosts than before
    four[0].load(str(tmp_path))
    assert four[0].get_state()["global_next_index"] == 32


def test_streams_resume(spark, tmp_path):
    ds, got = MapPipeline.range(spark, 25).seed(3).shuffle(), []
    for stop in (10, 25):
        run = stream(ds, stop, 5, lambda df, n: got.append((n, values(df))), str(tmp_path / "state"))
        run.processAllAvailable()
        run.stop()
    assert [x for _, part in sorted(got) for x in part] == values(ds.epoch()) and all(len(part) <= 5 for _, part in got)


def test_padding_and_advice(spark):
    df = spark.createDataFrame([(i, [1] * n) for i, n in enumerate((4, 8, 2))], "_idx long, f array<long>")
    fit = lambda best: padding_ratio(IterPipeline.source(df).pack({"f": 10}, 2, best=best).frame(), "f")
    assert fit(True) == fit(False) == pytest.approx(0.3)
    with pytest.raises(ValueError):
        pick_performance_config(MapPipeline.range(spark, 5).to_iter(), ram_budget_mb=0, max_workers=1)
    assert pick_performance_config(MapPipeline.range(spark, 5).to_iter(), ram_budget_mb=1, max_workers=8, max_buffer_size=9) == PerformanceConfig(8, 9)


def test_structs_are_batched_by_field(spark):
    rows = [(i, {"a": i, "b": {"c": [[i], [-i]]}}) for i in range(5)]
    ds = IterPipeline.source(spark.createDataFrame(rows, "_idx long, x struct<a: long, b: struct<c: array<array<long>>>>"))
    two = ds.batch(2)
    assert [r.x.asDict(True) for r in two.frame().orderBy("_idx").collect()] == [{"a": part, "b": {"c": [[[i], [-i]] for i in part]}} for part in ([0, 1], [2, 3], [4])]
    assert [r.x.a for r in two.rebatch(3).frame().orderBy("_idx").collect()] == [[0, 1, 2], [3, 4]]
    assert [r.x.b.c for r in two.rebatch(4, drop_remainder=True).frame().collect()] == [[[[i], [-i]] for i in range(4)]]
    padded = ds.batch(3, pad={"x": {"a": 9}}).frame().orderBy("_idx").collect()[1]
    assert padded.x.asDict(True) == {"a": [3, 4, 9], "b": {"c": [[[3], [-3]], [[4], [-4]], None]}}
    deep = spark.createDataFrame([(0, {"c": [[1], [2]]}), (1, {"c": [[1, 1], [2, 2]]})], "_idx long, x struct<c: array<array<long>>>")
    with pytest.raises(Exception, match="different shapes"):
        IterPipeline.source(deep).batch(2).frame().collect()
    assert IterPipeline.source(deep).batch(1).count() == 2


def test_rows_of_a_batch_grouped(spark):
    df = spark.createDataFrame([(0, [1, 2, 3], [5, 5, 5]), (1, [4, 5], [3, 3]), (2, [6], [0]), (3, [7, 8, 9], [2, 2, 2])], "_idx long, inputs array<long>, epoch array<long>")
    rows = IterPipeline.source(df).pack({"inputs": 3, "epoch": 3}, 4, shuffle_bins=True, shuffle_bins_group_by_feature="epoch").frame().orderBy("_idx").collect()
    assert [r.epoch for r in rows] == [[2, 2, 2], [3, 3, 0], [5, 5, 5]]


def test_a_loader_by_one_call(spark):
    source = spark.range(10).select(F.col("id").alias("_idx"), F.col("id").alias("value"))
    rows = list(load(source, 10, num_epochs=1, shuffle=True, seed=4, transformations=[Map({"value": "value * 2"})], batch_size=4))
    assert sorted(x for r in rows for x in r.value) == list(range(0, 20, 2)) and [len(r.value) for r in rows] == [4, 4, 2]
