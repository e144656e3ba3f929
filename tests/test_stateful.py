"""Stages over streams that stop in the middle and go on, against the batch form."""

import pytest
from pyspark.sql import functions as F

from tidewheel.pipeline import MapPipeline
from tidewheel.streaming.stateful import Batches, Packed, WindowShuffle, pipeline_stream, staged

N = 205


def source(spark):
    df = spark.range(N).select(F.col("id").alias("_idx"), (F.col("id") * 3).alias("value"), F.expr("transform(sequence(1, cast(1 + (id * 7) % 13 as int)), x -> cast(x + id as int))").alias("token"))
    return MapPipeline.source(df, N)


CASES = {
    "batches": (lambda: Batches(8), lambda it: it.map(value="value").batch(8), ["value"], 1),
    "dropped": (lambda: Batches(8, drop_remainder=True), lambda it: it.map(value="value").batch(8, drop_remainder=True), ["value"], 1),
    "window": (lambda: WindowShuffle(30, 5), lambda it: it.map(value="value").window_shuffle(30, 5), ["value"], 1),
    "packed": (lambda: Packed({"token": 16}, 3, seed=4), lambda it: it.map(token="token").pack({"token": 16}, 3, seed=4), ["token"], 1),
    "lanes": (lambda: Batches(8), lambda it: it.map(value="value").batch(8), ["value"], 3),
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_streams_stop_and_go_on(spark, tmp_path, case):
    stage, batched, columns, lanes = CASES[case]
    seen, out = [], str(tmp_path / "out")

    def sink(df, number):
        df.write.mode("append").parquet(out)
        seen.append(number)

    def start(stop):
        rows = staged(pipeline_stream(source(spark).map(**{c: c for c in columns}), stop, step=50), stage(), N, lanes)
        return rows.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "state")).start()

    first = start(100)  # ends inside a batch, a window and a batch of bins
    first.processAllAvailable()
    first.stop()
    half = len(seen)
    second = start(N)
    second.processAllAvailable()
    second.stop()
    assert half >= 2 and len(seen) > half
    got = spark.read.parquet(out).orderBy("_lane", "_idx").collect()
    for lane in range(lanes):
        it = source(spark).to_iter()
        want = batched(it.strided(lane, lanes) if lanes > 1 else it).frame().orderBy("_idx").collect()
        own = [r for r in got if r["_lane"] == lane]
        assert [{k: r[k] for k in want[0].asDict()} for r in own] == [r.asDict() for r in want]


def test_elements_out_of_order_are_an_error(spark, tmp_path):
    rows = staged(pipeline_stream(source(spark).map(value="value"), 20, step=20).where("_idx <> 7"), Batches(4), 20)
    query = rows.writeStream.foreachBatch(lambda df, n: df.count()).option("checkpointLocation", str(tmp_path)).start()
    with pytest.raises(Exception, match="goes on at|Streaming"):
        query.processAllAvailable()
    query.stop()
    for bad in (lambda: Batches(0), lambda: WindowShuffle(0, 1)):
        with pytest.raises(ValueError):
            bad()


def test_sources_start_where_the_package_is_not_found(spark):
    """The class of the index source travels whole, as its process need not find this package."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from tidewheel.streaming import index_stream as module

    cloudpickle.register_pickle_by_value(sys.modules[module.__name__])
    try:
        raw = cloudpickle.dumps(module.IndexSource)
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules[module.__name__])
    code = "import sys, pickle; s = pickle.load(sys.stdin.buffer)({'stop': '5'}); r = s.streamReader(None); print(r.latestOffset(), 'tidewheel' in sys.modules)"
    done = subprocess.run([sys.executable, "-c", code], input=raw, capture_output=True, cwd="/", timeout=60, check=True)
    assert b"{'next_index': 5} False" in done.stdout
