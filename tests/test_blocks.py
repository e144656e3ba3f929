"""Record files by blocks and Parquet files by row groups, against plain readers; which blocks a range opens."""

import datetime
import random

import oracle
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidewheel import catalogue
from tidewheel.cursor import Cursor
from tidewheel.functions.schedules import Shard
from tidewheel.sources import blocks, tfrecord

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Files of many, one and no records, lengths from none to more than a block."""
    at, rng = tmp_path_factory.mktemp("rec ords"), random.Random(5)
    rows = {"a.rec": [rng.randbytes(rng.choice([0, 3, 50, 700, 9000])) for _ in range(900)], "b.rec": [b"x" * 70_000], "c.rec": [], "d.rec": [b"", b"end"]}
    for name, own in rows.items():
        (at / name).write_bytes(b"".join(map(tfrecord.frame, own)))
    return at, [r for name in sorted(rows) for r in rows[name]]


def test_records_by_blocks(spark, folder):
    at, want = folder
    index = blocks.index_records(spark, str(at), block=30_000)
    plan = index.orderBy("first").collect()
    assert len(plan) > 30 and [r["first"] for r in plan] == [sum(q["rows"] for q in plan[:i]) for i in range(len(plan))]
    ds = blocks.records(spark, str(at), index)
    assert ds.n == len(want)
    got = ds.epoch().orderBy("_idx").collect()
    assert [bytes(r.record) for r in got] == want and [r["_idx"] for r in got] == list(range(len(want)))
    plain = {(r.path, r.offset): bytes(r.record) for r in tfrecord.read_tfrecords(spark, str(at)).collect()}
    assert {(r.path, r.offset): bytes(r.record) for r in got} == plain
    assert bytes(ds[450].record) == want[450] and bytes(ds[-1].record) == b"end"
    tail = ds.rows(len(want) - 2, len(want) + 3).orderBy("_idx").collect()  # over the end of an epoch
    assert [bytes(r.record) for r in tail] == [*want[-2:], *want[:3]]
    mixed = ds.shuffle(3).slice(slice(0, 40)).epoch().orderBy("_idx").collect()
    assert len({(r.path, r.offset) for r in mixed}) == 40
    assert ds.slice(slice(5, 5)).epoch().isEmpty()


def test_a_range_opens_its_blocks_only(spark, folder, tmp_path):
    at, want = folder
    ds = blocks.records(spark, str(at), block=30_000)
    opened = spark.sparkContext.accumulator(0)
    plain = ds._make

    def counted(*args):
        opened.add(1)
        yield from plain(*args)

    ds._make = counted
    assert [bytes(r.record) for r in ds.slice(slice(100, 103)).epoch().orderBy("_idx").collect()] == want[100:103]
    assert opened.value <= 2 < 30 < ds.blocks
    assert ds.epoch().count() == len(want) and opened.value >= ds.blocks
    assert ds.epoch().rdd.getNumPartitions() > 30


def test_damaged_and_changed_files(spark, folder, tmp_path):
    (tmp_path / "a").write_bytes(tfrecord.frame(b"abc") * 3)
    index = blocks.index_records(spark, str(tmp_path))
    (tmp_path / "a").write_bytes(tfrecord.frame(b"abc") * 4)
    with pytest.raises(ValueError):
        blocks.records(spark, str(tmp_path), index)
    for cut in (1, 5, 14):
        (tmp_path / "a").write_bytes((tfrecord.frame(b"abc") * 3)[:-cut])
        with pytest.raises(ValueError):
            list(blocks.record_blocks(str(tmp_path / "a"), (tmp_path / "a").stat().st_size))
    with pytest.raises(ValueError):
        blocks.records(spark, [])


def test_written_records(spark, tmp_path):
    df = spark.range(0, 500, 1, 6).selectExpr("cast(cast(id as string) as binary) AS record", "id AS other")
    done = tfrecord.write_tfrecords(df, f"file://{tmp_path}/out")
    assert sum(r.records for r in done.collect()) == 500 and done.count() == 6
    assert [bytes(r.record) for r in blocks.records(spark, f"{tmp_path}/out", block=200).epoch().orderBy("_idx").collect()] == [str(i).encode() for i in range(500)]


def test_row_groups(spark, tmp_path):
    when = datetime.datetime(2024, 1, 2, 3, 4, 5)
    table = pa.table({"k": pa.array(range(1000, 0, -1)), "a.b": pa.array([None, "x"] * 500), "v": [[1.5, None]] * 1000, "t": pa.array([when] * 1000, pa.timestamp("us"))})
    pq.write_table(table.slice(0, 700), tmp_path / "a.parquet", row_group_size=50)
    pq.write_table(table.slice(700), tmp_path / "b.parquet", row_group_size=120)
    ds = blocks.row_groups(spark, str(tmp_path))
    assert (ds.n, ds.blocks) == (1000, 14 + 3)
    want = [tuple(r.values()) for r in table.to_pylist()]
    assert [tuple(r)[1:] for r in ds.epoch().orderBy("_idx").collect()] == want
    stored = spark.read.parquet(str(tmp_path))
    assert ds.schema == stored.schema
    opened, plain = spark.sparkContext.accumulator(0), ds._make

    def counted(*args):
        opened.add(1)
        yield from plain(*args)

    ds._make = counted
    shard = ds.shard(Shard(1, 10)).epoch().collect()  # a sort would read twice, for its sample
    assert sorted(r.k for r in shard) == list(range(801, 901)) and opened.value == 2
    batches = ds.slice(slice(690, 720)).to_iter().batch(10).frame().orderBy("_idx").collect()
    assert [r.k for r in batches] == [list(range(310 - 10 * i, 300 - 10 * i, -1)) for i in range(3)]
    narrow = blocks.row_groups(spark, str(tmp_path), ["t", "k"])
    assert narrow.rows(1995, 2004).orderBy("_idx").columns == ["_idx", "t", "k"]
    assert [r.k for r in narrow.rows(1995, 2004).orderBy("_idx").collect()] == [5, 4, 3, 2, 1, 1000, 999, 998, 997]


def test_a_restored_cursor_opens_what_is_left(spark, folder):
    at, want = folder
    ds = blocks.records(spark, str(at), block=30_000)
    batches = ds.to_iter().batch(10)
    first = Cursor(batches)
    for _ in range(88):
        next(first)
    state = first.get_state()
    opened, again = spark.sparkContext.accumulator(0), blocks.records(spark, str(at), block=30_000)
    plain = again._make

    def counted(*args):
        opened.add(1)
        yield from plain(*args)

    again._make = counted
    left = Cursor(again.to_iter().batch(10))
    left.set_state(state)
    assert [bytes(r) for row in left for r in row["record"]] == want[880:]
    assert 0 < opened.value < ds.blocks / 2
    with pytest.raises(ValueError):
        Cursor(blocks.records(spark, f"{at}/a.rec").to_iter().batch(10)).set_state(state)


def test_queries(spark):
    con = oracle.connect(SF)
    for name in ("src_records", "src_row_groups"):
        assert not oracle.differences(catalogue.queries()[name](spark, SF), con, catalogue.oracle_sql()[name])
