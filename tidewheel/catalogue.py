"""A query for each operator over whole standard tables, and SQL with the same rows where SQL can say it.

Sources give their rows last key first, so that a rank is no key and a wrong place shows; customers stand in
for a second table of orders. The SQL takes every width, window and count from the rows.
"""

from __future__ import annotations

from collections.abc import Callable
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions.permutation import permute
from tidewheel.functions.schedules import Shard, default_seed, proportions
from tidewheel.functions.stats import execution_summary
from tidewheel.loader import DataLoader, IndexSampler, SequentialSampler
from tidewheel.operators import packing
from tidewheel.operators.transforms import Batch, Filter, Map, apply_all
from tidewheel.pipeline import IterPipeline, MapPipeline, elastic_batches, windows_lost
from tidewheel.plans.ranking import dense, with_index
from tidewheel.sources.blocks import records, row_groups
from tidewheel.sources.tables import iterate_parquet, scratch, stash
from tidewheel.sources.tfrecord import write_tfrecords

#: Bytes of a block of src_records, so that small tables have several.
RECORD_BLOCK = 1 << 16

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> MapPipeline:
    return MapPipeline.ordered(_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), F.col("o_orderkey").desc())


def _customers(spark: SparkSession, sf_dir: str) -> MapPipeline:
    """Customers in the columns of orders."""
    df = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_orderkey"), F.col("c_acctbal").alias("o_totalprice"))
    return MapPipeline.ordered(df, F.col("o_orderkey").desc())


def _events(spark: SparkSession, sf_dir: str) -> MapPipeline:
    return MapPipeline.ordered(_table(spark, sf_dir, "events").select("event_id", "value"), F.col("event_id").desc())


def _rows(ds: MapPipeline | IterPipeline, *columns: str) -> DataFrame:
    df = ds.epoch() if isinstance(ds, MapPipeline) else ds.frame()
    return df.select(F.col("_idx").alias("idx"), *columns)


ROWS = "SELECT row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS i, o_orderkey, o_totalprice FROM orders"
SECOND = "SELECT row_number() OVER (ORDER BY c_custkey DESC) - 1 AS i, c_custkey AS o_orderkey, c_acctbal AS o_totalprice FROM customer"
EVENTS = "SELECT row_number() OVER (ORDER BY event_id DESC) - 1 AS i, event_id, value FROM events"
#: Rows in blocks for the SQL side: number, place, key.
_UNNEST = "SELECT CAST(i // {b} AS BIGINT) AS batch, CAST(i % {b} AS BIGINT) AS pos, o_orderkey FROM ({rows})"


def _round_key_sql() -> str:
    """The seed sequence of each seed of the table `seeds`, as four words k0 .. k3: the steps of the standard's generator, one by one."""
    mask = 0xFFFFFFFF
    table = "SELECT seed, " + ", ".join(f"CAST({0x8B8B8B8B} AS UBIGINT) AS k{i}" for i in range(4)) + " FROM seeds"
    for step in range(8):
        here, near, far, last = (f"k{(step + d) % 4}" for d in (0, 1, 2, 3))
        if step < 4:
            x = f"xor(xor({here}, {near}), {last})"
            more = "(1 + 0 * seed)" if step == 0 else f"({step} + seed)" if step == 1 else str(step)
            first = f"((1664525 * xor({x}, {x} >> 27)) & {mask})"
            second = f"((r + {more}) & {mask})"
            new = {near: f"(({near} + r) & {mask})", far: f"(({far} + q) & {mask})", here: "q"}
        else:
            x = f"(({here} + {near} + {last}) & {mask})"
            first = f"((1566083941 * xor({x}, {x} >> 27)) & {mask})"
            second = f"((r + {mask + 1 - step % 4}) & {mask})"
            new = {near: f"xor({near}, r)", far: f"xor({far}, q)", here: "q"}
        table = f"SELECT seed, k0, k1, k2, k3, r, {second} AS q FROM (SELECT *, {first} AS r FROM ({table}))"
        table = "SELECT seed, " + ", ".join(f"{new.get(k, k)} AS {k}" for k in ("k0", "k1", "k2", "k3")) + f" FROM ({table})"
    return table


def permutation_sql(domain: str) -> str:
    """Rows (w, i, v) of the bijection of [0, n), by walking the cipher; domain gives rows (w, n, i, x, seed)."""

    def turn(x: str) -> str:
        a, b, c = (f"((({x} << {r}) | ({x} >> (h - {r}))) & m)" for r in ("1", "(8 % h)", "2"))
        return f"xor({a} & {b}, {c})"

    own = "w, n, i, h, m, k0, k1, k2, k3"
    step = f"SELECT {own}, v >> h AS l, v & m AS r, step FROM walk WHERE step = 0 OR v >= n"
    for a, b in (("k0", "k1"), ("k2", "k3")):
        step = f"SELECT {own}, xor(xor(l, {turn('r')}), {a} & m) AS l, r, step FROM ({step})"
        step = f"SELECT {own}, l, xor(xor(r, {turn('l')}), {b} & m) AS r, step FROM ({step})"
    wide = " + ".join(f"CASE WHEN n > {1 << 2 * h} THEN 1 ELSE 0 END" for h in range(8, 30))
    return f"""
      WITH RECURSIVE domain_ AS ({domain}), seeds AS (SELECT DISTINCT CAST(seed AS UBIGINT) AS seed FROM domain_), keys AS ({_round_key_sql()}),
      walk AS (
        SELECT w, CAST(n AS UBIGINT) AS n, i, h, CAST((1::UBIGINT << h) - 1 AS UBIGINT) AS m, k0, k1, k2, k3, CAST(x AS UBIGINT) AS v, 0 AS step
        FROM (SELECT *, CAST(8 + {wide} AS UBIGINT) AS h FROM domain_) d JOIN keys ON keys.seed = d.seed
        UNION ALL SELECT {own}, (l << h) | r AS v, step + 1 AS step FROM ({step})
      ) SELECT w, i, CAST(v AS BIGINT) AS v FROM walk WHERE step > 0 AND v < n"""


#: The multipliers and key steps of the counter-based generator Philox 4x64, and its rounds.
PHILOX_TIMES, PHILOX_STEPS, PHILOX_ROUNDS = (0xD2E7470EE14C6C93, 0xCA5A826395121157), (0x9E3779B97F4A7C15, 0xBB67AE8584CAA73B), 10


def _drawn_sql(rows: str, seed: int) -> str:
    """The rows with c0, the first 64 bits that the generator of each element i of a seed gives."""
    keys = [int(k) for k in np.random.Philox(seed).state["state"]["key"]]
    whole, half = "18446744073709551616::UHUGEINT", "UBIGINT"
    table = f"SELECT *, 1::{half} AS c0, 0::{half} AS c1, 0::{half} AS c2, CAST(i AS {half}) AS c3 FROM ({rows})"
    for turn in range(PHILOX_ROUNDS):
        a, b = ((k + turn * step) % (1 << 64) for k, step in zip(keys, PHILOX_STEPS, strict=True))
        table = f"SELECT *, c0::UHUGEINT * {PHILOX_TIMES[0]}::UHUGEINT AS p, c2::UHUGEINT * {PHILOX_TIMES[1]}::UHUGEINT AS q FROM ({table})"
        words = f"xor(xor(CAST(q // {whole} AS {half}), c1), {a}::{half}) AS c0, CAST(q % {whole} AS {half}) AS c1, xor(xor(CAST(p // {whole} AS {half}), c3), {b}::{half}) AS c2, CAST(p % {whole} AS {half}) AS c3"
        table = f"SELECT * EXCLUDE (c0, c1, c2, c3, p, q), {words} FROM ({table})"
    return table


SEED = 42
SHUFFLE_SEED = default_seed([(SEED, 1)])


def _shuffled(rows: str, seed: int = SHUFFLE_SEED) -> str:
    """(i, o_orderkey, ..) in shuffled order."""
    places = permutation_sql(f"SELECT 0 AS w, (SELECT count(*) FROM ({rows})) AS n, i, i AS x, {seed} AS seed FROM ({rows})")
    return f"SELECT p.i, s.* EXCLUDE (i) FROM ({places}) p JOIN ({rows}) s ON s.i = p.v"


@query(f"""WITH kept AS (SELECT row_number() OVER (ORDER BY i) - 1 AS i, o_orderkey FROM ({_shuffled(ROWS)}) WHERE o_totalprice > 100000)
SELECT CAST(i // 64 AS BIGINT) AS batch, CAST(i % 64 AS BIGINT) AS pos, o_orderkey FROM kept""")
def minimum_slice(spark, sf_dir):
    ds = _orders(spark, sf_dir).seed(SEED).shuffle().filter("o_totalprice > 100000").to_iter().batch(64)
    return _unnest(ds)


def _unnest(ds, *columns: str) -> DataFrame:
    df = ds.epoch() if isinstance(ds, MapPipeline) else ds.frame()
    columns = columns or ("o_orderkey",)
    return df.select(F.col("_idx").alias("batch"), F.posexplode(F.arrays_zip(*columns)).alias("pos", "_r")).select("batch", F.col("pos").cast("long").alias("pos"), *[f"_r.{c}" for c in columns])


@query("SELECT i AS idx, CAST(3 + 7 * i AS BIGINT) AS value FROM range(143) t(i)")
def src_range(spark, sf_dir):
    return _rows(MapPipeline.range(spark, 3, 1000, 7), "value")


@query("SELECT i AS idx, event_id, value FROM (" + EVENTS + ")")
def src_table(spark, sf_dir):
    return _rows(_events(spark, sf_dir), "event_id", "value")


@query(f"SELECT CAST((i - 10) // 3 AS BIGINT) AS idx, o_orderkey FROM ({ROWS}) WHERE i >= 10 AND i < 2000 AND (i - 10) % 3 = 0")
def slc_slice(spark, sf_dir):
    return _rows(_orders(spark, sf_dir)[10:2000:3], "o_orderkey")


@query(f"WITH s AS ({ROWS}) SELECT (SELECT count(*) FROM s) - 1 - i AS idx, o_orderkey FROM s")
def slc_negative_step(spark, sf_dir):
    return _rows(_orders(spark, sf_dir)[::-1], "o_orderkey")


@query(f"SELECT CAST(i // 4 AS BIGINT) AS idx, o_orderkey FROM ({ROWS}) WHERE i % 4 = 1")
def shd_strided(spark, sf_dir):
    return _rows(_orders(spark, sf_dir)[1::4], "o_orderkey")


@query(f"""WITH s AS ({ROWS}), b AS (SELECT 1 * (count(*) // 3) + least(1, count(*) % 3) AS lo, 2 * (count(*) // 3) + least(2, count(*) % 3) AS hi FROM s)
SELECT CAST(i - lo AS BIGINT) AS idx, o_orderkey FROM s, b WHERE i >= lo AND i < hi""")
def shd_even_split(spark, sf_dir):
    return _rows(_orders(spark, sf_dir).shard(Shard(1, 3)), "o_orderkey")


@query(f"""WITH s AS ({ROWS}), b AS (SELECT 1 * (count(*) // 4) + least(1, count(*) % 4) AS lo, 2 * (count(*) // 4) + least(2, count(*) % 4) AS hi FROM s)
SELECT CAST(e * (hi - lo) + i - lo AS BIGINT) AS idx, o_orderkey FROM s, b, range(2) t(e) WHERE i >= lo AND i < hi""")
def shd_epochs(spark, sf_dir):
    return _rows(_orders(spark, sf_dir).shard(Shard(1, 4)).repeat(2), "o_orderkey")


@query(f"SELECT i AS idx, o_orderkey FROM ({ROWS}) WHERE i < 500")
def lim_limit(spark, sf_dir):
    return _rows(_orders(spark, sf_dir).to_iter().limit(500), "o_orderkey")


@query("""WITH s AS (SELECT CAST(row_number() OVER () - 1 AS BIGINT) AS stored, o_orderkey FROM orders)
SELECT CAST(row_number() OVER (ORDER BY o_orderkey DESC, stored) - 1 AS BIGINT) AS idx, o_orderkey, stored FROM s""")
def src_parquet_files(spark, sf_dir):
    """The rows of Parquet files with their places in stored order, then one stream by key; rows of one key stay as stored."""
    rows = iterate_parquet(spark, f"{sf_dir}/orders.parquet").frame().select("o_orderkey", F.col("_idx").alias("stored"))
    return _rows(MapPipeline.ordered(rows, F.col("o_orderkey").desc(), "stored"), "o_orderkey", "stored")


@query("""WITH s AS (SELECT row_number() OVER () - 1 AS i, o_orderkey FROM orders), b AS (SELECT 1 * (count(*) // 3) + least(1, count(*) % 3) AS lo, 2 * (count(*) // 3) + least(2, count(*) % 3) AS hi FROM s)
SELECT CAST(i - lo AS BIGINT) AS idx, o_orderkey FROM s, b WHERE i >= lo AND i < hi""")
def src_row_groups(spark, sf_dir):
    """A shard of a Parquet file in stored order, from its own row groups."""
    return _rows(row_groups(spark, f"{sf_dir}/orders.parquet", ["o_orderkey"]).shard(Shard(1, 3)), "o_orderkey")


@query("SELECT CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS idx, event_id, event_type FROM events")
def src_records(spark, sf_dir):
    """All events, written as record files and read back by blocks and record numbers."""
    events = _table(spark, sf_dir, "events").repartitionByRange("event_id").sortWithinPartitions("event_id")
    folder = scratch(spark)
    write_tfrecords(events.select(F.concat_ws("|", "event_id", "event_type").cast("binary").alias("record")), folder)
    df = records(spark, folder, block=RECORD_BLOCK).epoch()
    parts = F.split(F.decode("record", "UTF-8"), r"\|", 2)
    return df.select(F.col("_idx").alias("idx"), parts[0].cast("long").alias("event_id"), parts[1].alias("event_type"))


@query(f"SELECT i AS idx, o_totalprice * 2 + o_orderkey AS v FROM ({ROWS})")
def map_expr(spark, sf_dir):
    return _rows(_orders(spark, sf_dir).map(v="o_totalprice * 2 + o_orderkey"), "v")


@query(f"SELECT i AS idx, o_orderkey % 97 AS v FROM ({ROWS})")
def map_pandas(spark, sf_dir):
    return _rows(_orders(spark, sf_dir).map_pandas(lambda b: b[["_idx"]].assign(v=b["o_orderkey"] % 97), "v long"), "v")


@query(f"SELECT i AS idx, i * 10 + o_orderkey % 10 AS v FROM ({ROWS})")
def map_with_index(spark, sf_dir):
    return _rows(_orders(spark, sf_dir).map_with_index(lambda i: {"v": i * 10 + F.col("o_orderkey") % 10}), "v")


@query(f"SELECT row_number() OVER (ORDER BY i) - 1 AS idx, (row_number() OVER (ORDER BY i) - 1) * 10 + o_orderkey % 10 AS v FROM ({ROWS}) WHERE o_totalprice < 150000")
def map_iter_index(spark, sf_dir):
    kept = _orders(spark, sf_dir).filter("o_totalprice < 150000").to_iter()
    return _rows(kept.map_with_index(lambda i: {"v": i * 10 + F.col("o_orderkey") % 10}), "v")


def _running(elements):
    """Every other element with the sum of the keys so far."""
    total = 0
    for i, x in enumerate(elements):
        total += x["o_orderkey"]
        if i % 2:
            yield {"o_orderkey": x["o_orderkey"], "total": total}


@query(f"SELECT i // 2 AS idx, o_orderkey, total FROM (SELECT i, o_orderkey, CAST(sum(o_orderkey) OVER (ORDER BY i) AS BIGINT) AS total FROM ({ROWS})) WHERE i % 2 = 1")
def map_operation(spark, sf_dir):
    return _rows(_orders(spark, sf_dir).to_iter().through(_running, "o_orderkey long, total long"), "o_orderkey", "total")


@query(f"SELECT row_number() OVER (ORDER BY i) - 1 AS idx, o_orderkey FROM ({ROWS}) WHERE o_totalprice < 150000")
def flt_filter(spark, sf_dir):
    return _rows(_orders(spark, sf_dir).to_iter().filter("o_totalprice < 150000"), "o_orderkey")


@query(f"SELECT i AS idx, o_orderkey, o_totalprice < 150000 AS present FROM ({ROWS})")
def flt_map_length(spark, sf_dir):
    return _orders(spark, sf_dir).filter("o_totalprice < 150000").epoch().select(F.col("_idx").alias("idx"), "o_orderkey", F.col("_present").alias("present"))


@query(f"SELECT CAST(i // 1000 AS BIGINT) AS win, count(*) AS n, count(*) FILTER (WHERE o_totalprice >= 150000) AS dropped FROM ({ROWS}) GROUP BY 1")
def flt_threshold_windows(spark, sf_dir):
    """What a filter's windows lose, as the filter itself counts it; a filter that allows that much passes, any stricter one fails."""
    ds = _orders(spark, sf_dir).to_iter()
    lost = windows_lost(ds.frame(), F.col("o_totalprice") < 150000, 1000)
    most = lost.where("n = 1000").agg(F.max("lost")).first()[0]
    if most:
        ds.filter("o_totalprice < 150000", raise_above=(most + 1) / 1000).count()
        try:
            ds.filter("o_totalprice < 150000", raise_above=most / 1000).count()
        except ValueError:
            return lost.select("win", "n", F.col("lost").alias("dropped"))
        raise AssertionError("a filter passes although a window loses too much")
    return lost.select("win", "n", F.col("lost").alias("dropped"))


@query(f"""WITH kept AS (SELECT row_number() OVER (ORDER BY i) - 1 AS i, o_orderkey + 1 AS o_orderkey FROM ({ROWS}) WHERE (o_orderkey + 1) % 2 = 0)
{_UNNEST.format(b=10, rows="SELECT * FROM kept")}""")
def apply_chain(spark, sf_dir):
    return _unnest(apply_all(_orders(spark, sf_dir).to_iter(), [Map({"o_orderkey": "o_orderkey + 1"}), Filter("o_orderkey % 2 = 0"), Batch(10)]))


@query(r"""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS p FROM documents)
SELECT row_number() OVER (ORDER BY doc_id, p) - 1 AS idx, word FROM w""")
def flm_words(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_idx"), "text")
    return _rows(IterPipeline.source(docs).flat_map("split(text, ' ', -1)", "word"), "word")


@query(f"SELECT a.i AS idx, a.o_orderkey AS k1, b.o_orderkey AS k2 FROM ({ROWS}) a JOIN (SELECT (SELECT count(*) FROM ({ROWS})) - 1 - i AS i, o_orderkey FROM ({ROWS})) b USING (i)")
def zip_reversed(spark, sf_dir):
    ds = _orders(spark, sf_dir)
    return MapPipeline.zip([ds, ds[::-1]]).epoch().select(F.col("_idx").alias("idx"), F.col("_1.o_orderkey").alias("k1"), F.col("_2.o_orderkey").alias("k2"))


@query(f"SELECT a.i AS idx, o_orderkey, event_id FROM ({ROWS}) a JOIN ({EVENTS}) b USING (i)")
def zip_shortest(spark, sf_dir):
    ds = IterPipeline.zip([_orders(spark, sf_dir).to_iter(), _events(spark, sf_dir).to_iter()], strict=False)
    return ds.frame().select(F.col("_idx").alias("idx"), F.col("_1.o_orderkey").alias("o_orderkey"), F.col("_2.event_id").alias("event_id"))


@query(f"WITH s AS ({ROWS}), n AS (SELECT count(*) AS n FROM s) SELECT t.i AS idx, s.o_orderkey FROM s t, n JOIN s ON s.i = (t.i * 37 + t.i // (n // gcd(n, 37))) % n")
def idx_reindex(spark, sf_dir):
    ds = _orders(spark, sf_dir)
    cycle = ds.n // gcd(ds.n, 37)
    i = F.col("id")
    wanted = spark.range(ds.n).select(i.alias("_idx"), F.lit(0).alias("input"), F.pmod(i * 37 + F.floor(i / cycle), F.lit(ds.n)).alias("index"))
    return _rows(MapPipeline.select_from([ds], wanted), "o_orderkey")


@query(f"WITH a AS ({ROWS}), b AS ({SECOND}) SELECT (SELECT count(*) FROM b) - 1 - i AS idx, 'customer' AS which, o_orderkey FROM b UNION ALL SELECT (SELECT count(*) FROM b) + (SELECT count(*) FROM a) - 1 - i, 'order', o_orderkey FROM a")
def idx_selection_map(spark, sf_dir):
    """The second input backwards, then the first, by a frame of selections."""
    a, b = (f(spark, sf_dir).map(o_orderkey="o_orderkey", which=F.lit(w)) for f, w in ((_orders, "order"), (_customers, "customer")))
    i, second = F.col("id"), F.col("id") < b.n
    wanted = spark.range(a.n + b.n).select(i.alias("_idx"), second.cast("int").alias("input"), F.when(second, b.n - 1 - i).otherwise(a.n + b.n - 1 - i).alias("index"))
    return _rows(MapPipeline.select_from([a, b], wanted), "which", "o_orderkey")


@query(f"SELECT i AS idx, o_orderkey FROM ({ROWS}) UNION ALL SELECT i + (SELECT count(*) FROM ({ROWS})), o_orderkey FROM ({SECOND})")
def cat_concat(spark, sf_dir):
    return _rows(MapPipeline.concatenate([_orders(spark, sf_dir), _customers(spark, sf_dir)]), "o_orderkey")


def _mix_sql(parts: list[int], last: str) -> str:
    """A two-input mix up to position `last`: k takes from the first input if the second's share of k rows doesn't grow there."""
    total, free = sum(parts), parts[1]
    first = f"k + 1 - (k + 1) * {free} // {total} - (k - k * {free} // {total})"
    return f"""WITH f AS ({ROWS}), o AS ({SECOND}), nf AS (SELECT count(*) AS n FROM f), no AS (SELECT count(*) AS n FROM o),
    k AS (SELECT k, {first} AS d, k * {free} // {total} AS j1, k - k * {free} // {total} AS j0 FROM (SELECT unnest(range({last})) AS k FROM nf, no)),
    s AS (SELECT k, d, CASE WHEN d = 1 THEN j0 ELSE j1 END AS j FROM k)
    SELECT k AS idx, coalesce(f.o_orderkey, o.o_orderkey) AS o_orderkey FROM s LEFT JOIN f ON s.d = 1 AND f.i = s.j LEFT JOIN o ON s.d = 0 AND o.i = s.j"""


#: Customers are fewer than orders, so they have the small part.
MIX = proportions([0.9, 0.1], 2)


@query(_mix_sql(MIX, f"CAST(trunc(least(nf.n / ({MIX[0]}::DOUBLE / {sum(MIX)}), no.n / ({MIX[1]}::DOUBLE / {sum(MIX)}))) AS BIGINT)"))
def mix_weighted(spark, sf_dir):
    return _rows(MapPipeline.mix([_orders(spark, sf_dir), _customers(spark, sf_dir)], [0.9, 0.1]), "o_orderkey")


# The row after the last of each input would stand at these positions; the first of them ends the mix.
@query(_mix_sql(MIX, f"least(nf.n * {sum(MIX)} // {MIX[0]}, ((no.n + 1) * {sum(MIX)} + {MIX[1] - 1}) // {MIX[1]} - 1)"))
def mix_iter_stop(spark, sf_dir):
    return _rows(IterPipeline.mix([_orders(spark, sf_dir).to_iter(), _customers(spark, sf_dir).to_iter()], [0.9, 0.1]), "o_orderkey")


_FILES = "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS d, n_nationkey FROM nation"
_OF_FILE = f"SELECT d, c_custkey, row_number() OVER (PARTITION BY d ORDER BY c_custkey) - 1 AS j FROM customer JOIN ({_FILES}) ON c_nationkey = n_nationkey"


def _in_nations(spark, sf_dir) -> tuple[DataFrame, list[int]]:
    """Customers with their places by key among those of their nation, and the nations by key."""
    nations = [r[0] for r in _table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_nationkey").collect()]
    customers = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    low, high = customers.agg(F.min("c_custkey"), F.max("c_custkey")).first()
    customers = customers.withColumn("_idx", F.col("c_custkey") - (low or 0))
    return stash(dense(customers, "_idx", (high or 0) - (low or 0) + 1, by=["c_nationkey"], lanes=max(len(nations), 1))), nations


def _by_nation(spark, sf_dir) -> list[IterPipeline]:
    """Customers of each nation, by key."""
    ranked, nations = _in_nations(spark, sf_dir)
    return [IterPipeline.source(ranked.where(F.col("c_nationkey") == k).select("_idx", "c_custkey")) for k in nations]


@query(f"SELECT row_number() OVER (ORDER BY j, d) - 1 AS idx, c_custkey FROM ({_OF_FILE})")
def itl_interleave(spark, sf_dir):
    files = _by_nation(spark, sf_dir)
    return _rows(IterPipeline.interleave(files, len(files)), "c_custkey")


_SHORT_CYCLE = f"""WITH RECURSIVE s AS ({_OF_FILE}),
c AS (SELECT list(n ORDER BY d) AS sizes FROM (SELECT d, (SELECT count(*) FROM s WHERE s.d = t.d) AS n FROM ({_FILES}) t)),
turns AS (
  SELECT CAST(0 AS BIGINT) AS v, [CAST(-1 AS BIGINT), -1] AS held, [CAST(0 AS BIGINT), 0] AS places, CAST(0 AS BIGINT) AS following, CAST(NULL AS BIGINT) AS d, CAST(NULL AS BIGINT) AS j
  UNION ALL
  SELECT v + 1, list_transform(held, lambda x, k: CASE WHEN k = slot THEN CASE WHEN gives THEN own ELSE CAST(-1 AS BIGINT) END ELSE x END), list_transform(places, lambda x, k: CASE WHEN k = slot THEN CASE WHEN gives THEN at_ + 1 ELSE CAST(0 AS BIGINT) END ELSE x END), next_, CASE WHEN gives THEN own END, CASE WHEN gives THEN at_ END
  FROM (
    SELECT *, own >= 0 AND at_ < coalesce(sizes[own + 1], 0) AS gives FROM (
      SELECT v, held, places, sizes, slot, CASE WHEN held[slot] < 0 AND following < len(sizes) THEN following ELSE held[slot] END AS own, CASE WHEN held[slot] < 0 THEN 0 ELSE places[slot] END AS at_, CASE WHEN held[slot] < 0 AND following < len(sizes) THEN following + 1 ELSE following END AS next_
      FROM (SELECT *, CAST(v % 2 + 1 AS BIGINT) AS slot FROM turns) t, c WHERE following < len(sizes) OR list_max(held) >= 0))
)
SELECT row_number() OVER (ORDER BY v) - 1 AS idx, c_custkey FROM turns JOIN s ON s.d = turns.d AND s.j = turns.j"""


@query(_SHORT_CYCLE)
def itl_short_cycle(spark, sf_dir):
    return _rows(IterPipeline.interleave(_by_nation(spark, sf_dir), 2), "c_custkey")


@query(f"WITH s AS ({ROWS}) SELECT e * (SELECT count(*) FROM s) + i AS idx, o_orderkey FROM s, range(3) t(e)")
def rpt_repeat(spark, sf_dir):
    return _rows(_orders(spark, sf_dir).to_iter().repeat(3), "o_orderkey")


_TWO_EPOCHS = permutation_sql(f"SELECT e AS w, (SELECT count(*) FROM ({ROWS})) AS n, i, i AS x, {SHUFFLE_SEED} + e AS seed FROM ({ROWS}), range(2) t(e)")


@query(f"SELECT w * (SELECT count(*) FROM ({ROWS})) + p.i AS idx, o_orderkey FROM ({_TWO_EPOCHS}) p JOIN ({ROWS}) s ON s.i = p.v")
def rpt_shuffle_epochs(spark, sf_dir):
    return _rows(_orders(spark, sf_dir).seed(SEED).shuffle().repeat(2), "o_orderkey")


@query(f"SELECT i AS idx, o_orderkey FROM ({_shuffled(ROWS)})")
def shf_global(spark, sf_dir):
    return _rows(_orders(spark, sf_dir).seed(SEED).shuffle(), "o_orderkey")


WINDOW = 1000
def _windows(rows: str, window: int, seed: int = 7, clip: bool = True) -> str:
    size = f"least({window}, (SELECT count(*) FROM ({rows})) - i // {window} * {window})" if clip else str(window)
    return permutation_sql(f"SELECT i // {window} AS w, {size} AS n, i, i % {window} AS x, {seed} + i // {window} AS seed FROM ({rows})")


_WINDOWS = _windows(ROWS, WINDOW)


@query(f"SELECT p.i AS idx, o_orderkey FROM ({_WINDOWS}) p JOIN ({ROWS}) s ON s.i = p.w * {WINDOW} + p.v")
def shf_window_map(spark, sf_dir):
    return _rows(_orders(spark, sf_dir).window_shuffle(WINDOW, 7, clip_last=True), "o_orderkey")


@query(f"SELECT p.i AS idx, o_orderkey FROM ({_windows(ROWS, WINDOW, clip=False)}) p JOIN ({ROWS}) s ON s.i = (p.w * {WINDOW} + p.v) % (SELECT count(*) FROM ({ROWS}))")
def shf_window_parity(spark, sf_dir):
    """A short last window reaches into the next epoch."""
    return _rows(_orders(spark, sf_dir).window_shuffle(WINDOW, 7), "o_orderkey")


@query(f"SELECT p.w * {WINDOW} + least({WINDOW}, (SELECT count(*) FROM ({ROWS})) - p.w * {WINDOW}) - 1 - p.i % {WINDOW} AS idx, o_orderkey FROM ({_WINDOWS}) p JOIN ({ROWS}) s ON s.i = p.w * {WINDOW} + p.v")
def shf_window_iter(spark, sf_dir):
    return _rows(_orders(spark, sf_dir).to_iter().window_shuffle(WINDOW, 7), "o_orderkey")


_FILE_ORDER = permutation_sql(f"SELECT 0 AS w, (SELECT count(*) FROM nation) AS n, d AS i, d AS x, {SHUFFLE_SEED} AS seed FROM ({_FILES})")
_MERGED = f"SELECT row_number() OVER (ORDER BY j, p.i) - 1 AS i, c_custkey FROM ({_OF_FILE}) f JOIN ({_FILE_ORDER}) p ON f.d = p.v"


@query(f"SELECT p.w * 100 + least(100, (SELECT count(*) FROM ({_MERGED})) - p.w * 100) - 1 - p.i % 100 AS idx, c_custkey FROM ({_windows(_MERGED, 100)}) p JOIN ({_MERGED}) s ON s.i = p.w * 100 + p.v")
def shf_hierarchical(spark, sf_dir):
    ranked, nations = _in_nations(spark, sf_dir)
    order = permute(range(len(nations)), len(nations), SHUFFLE_SEED)
    files = spark.createDataFrame([(nations[k], i) for i, k in enumerate(order)], "c_nationkey long, file long")
    rows = ranked.join(F.broadcast(files), "c_nationkey").select("_idx", "c_custkey", "file")
    return _rows(IterPipeline.interleave_parts(rows, "file", len(nations), len(nations)).window_shuffle(100, 7), "c_custkey")


@query(_UNNEST.format(b=100, rows=ROWS))
def bat_batch(spark, sf_dir):
    return _unnest(_orders(spark, sf_dir).batch(100))


@query(_UNNEST.format(b=100, rows=f"SELECT * FROM ({ROWS}) WHERE i < (SELECT count(*) // 100 * 100 FROM ({ROWS}))"))
def bat_drop_remainder(spark, sf_dir):
    return _unnest(_orders(spark, sf_dir).batch(100, drop_remainder=True))


@query(f"""WITH s AS ({ROWS}), n AS (SELECT count(*) AS n, -(-count(*) // 100) AS _, (count(*) + 99) // 100 * 100 AS m FROM s)
SELECT CAST(k // 100 AS BIGINT) AS batch, CAST(k % 100 AS BIGINT) AS pos, coalesce(o_orderkey, -1) AS o_orderkey FROM (SELECT unnest(range(m)) AS k FROM n) LEFT JOIN s ON i = k""")
def bat_pad(spark, sf_dir):
    return _unnest(_orders(spark, sf_dir).batch(100, pad={"o_orderkey": -1, "o_totalprice": 0.0}))


@query(f"SELECT CAST(i // 256 AS BIGINT) AS batch, count(*) AS n, min(o_orderkey) AS low, max(o_totalprice) AS high FROM ({ROWS}) GROUP BY 1")
def bat_aggregate(spark, sf_dir):
    ds = _orders(spark, sf_dir).batch(256, aggregates=[F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("low"), F.max("o_totalprice").alias("high")])
    return ds.epoch().withColumnRenamed("_idx", "batch")


@query(f"SELECT CAST(i // 100 AS BIGINT) AS batch, CAST(max(i) AS BIGINT) AS last_index, max_by(o_orderkey, i) AS last_key, count(*) AS n FROM ({ROWS}) GROUP BY 1")
def bat_last_record(spark, sf_dir):
    ds = _orders(spark, sf_dir).to_iter().batch(100, aggregates=[F.max("_idx").alias("last_index"), F.max_by("o_orderkey", "_idx").alias("last_key"), F.count(F.lit(1)).alias("n")])
    return ds.frame().withColumnRenamed("_idx", "batch")


@query(_UNNEST.format(b=70, rows=ROWS))
def bat_rebatch(spark, sf_dir):
    return _unnest(IterPipeline.source(_orders(spark, sf_dir).batch(100).epoch()).rebatch(70))


def _summary(batch: pd.DataFrame) -> dict[str, object]:
    """The span of a batch's keys, and the key of its dearest order."""
    keys = batch["o_orderkey"]
    return {"span": int(keys.iloc[0] - keys.iloc[-1]), "dearest": int(keys.loc[batch["o_totalprice"].idxmax()])}


@query(f"SELECT CAST(i // 256 AS BIGINT) AS batch, max(o_orderkey) - min(o_orderkey) AS span, arg_max(o_orderkey, (o_totalprice, -i)) AS dearest FROM ({ROWS}) GROUP BY 1")
def bat_function(spark, sf_dir):
    ds = _orders(spark, sf_dir).batch(256, function=_summary, schema="span long, dearest long")
    return ds.epoch().withColumnRenamed("_idx", "batch")


@query(f"SELECT row_number() OVER (ORDER BY i) - 1 AS idx, o_orderkey FROM ({ROWS}) WHERE o_orderkey % 3 > 0")
def map_null_filter(spark, sf_dir):
    return _rows(_orders(spark, sf_dir).map_or_drop(o_orderkey="nullif(o_orderkey, IF(o_orderkey % 3 > 0, NULL, o_orderkey))").to_iter(), "o_orderkey")


@query(f"SELECT i * 3 + k AS idx, o_orderkey, CAST(k * 10 AS BIGINT) AS part FROM ({ROWS}), range(3) t(k) WHERE k <= o_orderkey % 3")
def flm_map(spark, sf_dir):
    return _rows(_orders(spark, sf_dir).flat_map("transform(sequence(0L, o_orderkey % 3), x -> x * 10)", 3, "part"), "o_orderkey", "part")


CLIP = 512


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in consecutive pieces of at most CLIP words: _idx, doc_id, since (words before), token (a number for each word)."""
    tokens = F.transform(F.split("text", " ", -1), lambda w: F.length(w).cast("long"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce(tokens, F.array().cast("array<long>")).alias("all"))
    last = F.greatest(F.size("all") - 1, F.lit(0))
    cut = docs.withColumn("since", F.explode(F.sequence(F.lit(0), last, F.lit(CLIP))))
    return with_index(cut.select("doc_id", F.col("since").cast("long").alias("since"), F.slice("all", F.col("since") + 1, F.lit(CLIP)).alias("token")), "doc_id", "since")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts: _idx, token (a number for each word)."""
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_idx"), F.transform(F.split("text", " ", -1), lambda w: F.length(w).cast("long")).alias("token"))


_PIECES = f"""SELECT row_number() OVER (ORDER BY doc_id, k) - 1 AS piece, doc_id, CAST(k AS BIGINT) AS since, CAST(least({CLIP}, n - k) AS BIGINT) AS n
FROM (SELECT doc_id, n, unnest(range(0, greatest(n, 1), {CLIP})) AS k FROM (SELECT doc_id, coalesce(len(string_split(text, ' ')), 0) AS n FROM documents))"""


def _packed(spark, sf_dir, **how) -> DataFrame:
    """Where each piece stands, read back from the packed rows."""
    rows = IterPipeline.source(_pieces(spark, sf_dir)).pack({"token": CLIP}, 8, meta=["doc_id", "since"], shuffle_bins=False, **how).frame()
    pieces = rows.select(F.col("_idx").alias("row"), "token_segment_ids", F.posexplode(F.arrays_zip("doc_id", "since")).alias("k", "m"))
    segment = (F.col("k") + 1).cast("long")
    own = F.filter("token_segment_ids", lambda x: x == segment)
    return pieces.select("row", segment.alias("segment"), "m.doc_id", "m.since", (F.array_position("token_segment_ids", segment.cast("int")) - 1).alias("at"), F.size(own).cast("long").alias("size"))


def _packed_sql(**how) -> str:
    return f"SELECT f.row, f.segment, p.doc_id, p.since, f.at, f.size FROM ({_packing_sql(**how)}) f JOIN ({_PIECES}) p ON p.piece = f.doc_id"


def _places(df: DataFrame) -> DataFrame:
    return df.select("row", F.col("segment").cast("long").alias("segment"), F.col("_idx").alias("doc_id"), F.col("at")[0].alias("at"), F.col("size")[0].alias("size"))


def _packing_sql(best: bool = False, most: int = 1 << 40, align: int = 1, workers: int = 1) -> str:
    """Places of pieces (as doc_id), packed one after the other by a recursive query; workers pack strided parts, whose rows are taken in turn."""
    score = "used[k]" if best else "9 - k"
    return f"""WITH RECURSIVE d AS (SELECT piece AS doc_id, n, piece % {workers} AS w, row_number() OVER (PARTITION BY piece % {workers} ORDER BY piece) - 1 AS i FROM ({_PIECES})),
fill AS (
  SELECT w, CAST(-1 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS doc_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS gone, list_transform(range(8), lambda k: CAST(0 AS BIGINT)) AS used, list_transform(range(8), lambda k: CAST(0 AS BIGINT)) AS held, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS segment, CAST(0 AS BIGINT) AS begun
  FROM (SELECT DISTINCT w FROM d)
  UNION ALL
  SELECT w, i, doc_id, n, gone, list_transform(used, lambda x, k: CAST(CASE WHEN k = b THEN (x + n + {align - 1}) // {align} * {align} ELSE x END AS BIGINT)), list_transform(held, lambda x, k: CAST(x + CASE WHEN k = b THEN 1 ELSE 0 END AS BIGINT)), CAST(gone + b - 1 AS BIGINT), CAST(held[b] + 1 AS BIGINT), used[b]
  FROM (
    SELECT w, i, doc_id, n, CASE WHEN top < 0 THEN gone + len(list_filter(held, lambda x: x > 0)) ELSE gone END AS gone, CASE WHEN top < 0 THEN list_transform(used, lambda x: CAST(0 AS BIGINT)) ELSE used END AS used,
      CASE WHEN top < 0 THEN list_transform(held, lambda x: CAST(0 AS BIGINT)) ELSE held END AS held, CASE WHEN top < 0 THEN 1 ELSE list_position(scores, top) END AS b
    FROM (SELECT *, list_max(scores) AS top FROM (
      SELECT f.w, d.i, d.doc_id, d.n, f.gone, f.used, f.held, list_transform(range(1, 9), lambda k: CASE WHEN f.used[k] + d.n <= {CLIP} AND f.held[k] < {most} THEN {score.replace("used", "f.used")} ELSE -1 END) AS scores
      FROM fill f JOIN d ON d.w = f.w AND d.i = f.i + 1))
  )
), c AS (SELECT w, max(r) + 1 AS c FROM fill WHERE i >= 0 GROUP BY w)
SELECT CAST((SELECT sum(least(c.c, f.r + CASE WHEN c.w < f.w THEN 1 ELSE 0 END)) FROM c) AS BIGINT) AS row, segment, doc_id, begun AS at, n AS size FROM fill f WHERE i >= 0"""


@query(_packed_sql())
def pck_first_fit(spark, sf_dir):
    return _packed(spark, sf_dir)


@query(_packed_sql(best=True))
def pck_best_fit(spark, sf_dir):
    return _packed(spark, sf_dir, best=True)


@query(_packed_sql(most=3))
def pck_max_seq(spark, sf_dir):
    return _packed(spark, sf_dir, max_sequences_per_bin=3)


@query(_packed_sql(align=64))
def pck_align(spark, sf_dir):
    return _packed(spark, sf_dir, align={"token": 64})


@query(_packed_sql(workers=4))
def pck_workers(spark, sf_dir):
    return _packed(spark, sf_dir, workers=4)


@query(f"""WITH p AS (SELECT * FROM ({_packing_sql()})), b AS (SELECT row // 8 AS batch, max(doc_id) AS last_index FROM p GROUP BY 1),
g AS (SELECT row, count(*) AS segments, sum(size) AS used, sum(segment * (size * (size - 1) // 2)) AS digest FROM p GROUP BY row)
SELECT CAST(batch AS BIGINT) AS batch, CAST(k AS BIGINT) AS bin, last_index, CAST(coalesce(segments, 0) AS BIGINT) AS segments, CAST(coalesce(used, 0) AS BIGINT) AS used, CAST(coalesce(digest, 0) AS BIGINT) AS digest, CAST({CLIP} AS BIGINT) AS cells
FROM b CROSS JOIN range(8) t(k) LEFT JOIN g ON g.row = batch * 8 + k""")
def pck_and_batch(spark, sf_dir):
    return _pack_and_batch(_pieces(spark, sf_dir).select("_idx", "token"))


def _pack_and_batch(docs: DataFrame) -> DataFrame:
    df = IterPipeline.source(docs).pack_and_batch({"token": CLIP}, 8).frame()
    rows = df.select(F.col("_idx").alias("batch"), "last_index", F.posexplode(F.arrays_zip(F.col("token_segment_ids").alias("s"), F.col("token_positions").alias("p"), F.col("token").alias("t"))).alias("bin", "r"))
    digest = F.aggregate(F.zip_with("r.s", "r.p", lambda a, b: (a * b).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    return rows.select(
        "batch", F.col("bin").cast("long").alias("bin"), "last_index", F.array_max("r.s").cast("long").alias("segments"),
        F.size(F.filter("r.s", lambda x: x > 0)).cast("long").alias("used"), digest.alias("digest"), F.size("r.t").cast("long").alias("cells"))


@query(f"""WITH s AS (SELECT doc_id, CAST(len(string_split(text, ' ')) AS BIGINT) AS n FROM documents),
c AS (SELECT doc_id, n, CAST(sum(n) OVER (ORDER BY doc_id) - n AS BIGINT) AS a FROM s),
p AS (SELECT doc_id, n, a, unnest(range(a // {CLIP}, (a + n - 1) // {CLIP} + 1)) AS r FROM c)
SELECT r AS row, row_number() OVER (PARTITION BY r ORDER BY doc_id) AS segment, doc_id, greatest(a, r * {CLIP}) - r * {CLIP} AS at, least(a + n, (r + 1) * {CLIP}) - greatest(a, r * {CLIP}) AS size FROM p""")
def pck_concat_split(spark, sf_dir):
    df = _words(spark, sf_dir).select("_idx", F.array(F.size("token").cast("long")).alias("len"))
    return _places(packing.assign_prefix_sums(df, CLIP, df.agg(F.max("_idx")).first()[0] + 1))


@query(f"""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS p FROM documents),
g AS (SELECT doc_id, word, row_number() OVER (ORDER BY doc_id, p) - 1 AS k, p FROM w),
c AS (SELECT k // {CLIP} AS row, k % {CLIP} AS pos, CASE WHEN p = 1 OR k % {CLIP} = 0 THEN -1 ELSE length(word) END AS token FROM g)
SELECT row, sum(token * (pos + 1))::BIGINT AS digest, count(*) AS used FROM c GROUP BY row""")
def pck_concat_split_bos(spark, sf_dir):
    return _cut_with_bos(_words(spark, sf_dir))


def _cut_with_bos(docs: DataFrame) -> DataFrame:
    df = IterPipeline.source(docs).concat_then_split({"token": CLIP}, bos={"token": -1}).frame()
    digest = F.aggregate(F.transform("token", lambda x, i: x * (i + 1)), F.lit(0).cast("long"), lambda s, x: s + x)
    return df.select(F.col("_idx").alias("row"), digest.alias("digest"), F.size(F.filter("token_segment_ids", lambda x: x > 0)).cast("long").alias("used"))


def _loader(spark, sf_dir, workers: int) -> DataFrame:
    ds = _orders(spark, sf_dir)
    sampler = IndexSampler(ds.n, shuffle=True, num_epochs=1, seed=SHUFFLE_SEED)
    return _unnest(DataLoader(ds.epoch(), sampler, [Filter("o_totalprice > 100000"), Batch(64)], workers).pipeline())


@query(_SQL["minimum_slice"])
def dl_loader(spark, sf_dir):
    return _loader(spark, sf_dir, 1)


@query(f"""WITH kept AS (SELECT i % 3 AS w, row_number() OVER (PARTITION BY i % 3 ORDER BY i) - 1 AS j, o_orderkey FROM ({_shuffled(ROWS)}) WHERE o_totalprice > 100000),
b AS (SELECT w, j // 64 AS n, j % 64 AS pos, o_orderkey FROM kept), o AS (SELECT w, n, row_number() OVER (ORDER BY n, w) - 1 AS batch FROM (SELECT DISTINCT w, n FROM b))
SELECT batch, CAST(pos AS BIGINT) AS pos, o_orderkey FROM b JOIN o USING (w, n)""")
def dl_workers(spark, sf_dir):
    return _loader(spark, sf_dir, 3)


_SHARD = f"SELECT i - lo AS i, o_orderkey FROM ({ROWS}), (SELECT 1 * (count(*) // 4) + least(1, count(*) % 4) AS lo, 2 * (count(*) // 4) + least(2, count(*) % 4) AS hi FROM ({ROWS})) WHERE i >= lo AND i < hi"


@query(f"SELECT i AS idx, o_orderkey FROM ({_shuffled(_SHARD)})")
def dl_sharded(spark, sf_dir):
    ds = _orders(spark, sf_dir)
    return _rows(DataLoader(ds.epoch(), IndexSampler(ds.n, Shard(1, 4), shuffle=True, num_epochs=1, seed=SHUFFLE_SEED)).pipeline(), "o_orderkey")


@query(f"SELECT p.i * 1 AS index, p.v AS key FROM ({permutation_sql(f'SELECT 0 AS w, (SELECT count(*) FROM ({ROWS})) AS n, i, i AS x, 5 AS seed FROM ({ROWS})')}) p")
def smp_index(spark, sf_dir):
    n = _orders(spark, sf_dir).n
    keys = IndexSampler(n, shuffle=True, num_epochs=1, seed=5).keys(spark, 0, n)
    return keys.select(F.col("_index").alias("index"), F.col("_record_key").alias("key"))


@query(f"SELECT i AS index, i AS key FROM ({ROWS}) WHERE i < (SELECT count(*) // 4 * 4 FROM ({ROWS}))")
def smp_sequential(spark, sf_dir):
    sampler = SequentialSampler(_orders(spark, sf_dir).n, Shard(0, 4, drop_remainder=True))
    return sampler.keys(spark, 0, len(sampler)).select(F.col("_index").alias("index"), F.col("_record_key").alias("key"))


@query(f"""WITH s AS ({ROWS}), t AS (SELECT i - 96 AS q, o_orderkey FROM s WHERE i >= 96 AND i < 96 + (SELECT (count(*) - 96) // 32 * 32 FROM s)),
h AS (SELECT q // 4 AS i, o_orderkey FROM t WHERE q % 4 = 2) {_UNNEST.format(b=8, rows="SELECT * FROM h")}""")
def elastic_resume(spark, sf_dir):
    return _unnest(elastic_batches(_orders(spark, sf_dir), 32, Shard(2, 4), next_index=96))


# A number below 1,000 comes from 32 bits; the few products whose low half is below 2**32 % 1000 are drawn again from the next 32.
@query(f"""SELECT i AS idx, o_orderkey, CAST(CASE WHEN (c0 % 4294967296) * 1000 % 4294967296 < 296 THEN (c0 // 4294967296) * 1000 // 4294967296 ELSE (c0 % 4294967296) * 1000 // 4294967296 END AS BIGINT) AS drawn
FROM ({_drawn_sql(ROWS, default_seed([(41, 1)]))})""")
def random_map(spark, sf_dir):
    ds = _orders(spark, sf_dir).seed(41).random_map(lambda g: int(g.integers(0, 1000)), "long", "drawn")
    return _rows(ds, "o_orderkey", "drawn")


@query(f"SELECT i AS idx, o_orderkey, CAST(c0 // 4 AS BIGINT) AS drawn FROM ({_drawn_sql(ROWS, 41)})")
def random_map_workers(spark, sf_dir):
    """Three workers; each element draws by its worker's number and its place there, so no two draw alike."""
    draw = lambda part: part.random_map(lambda g: int(g.integers(0, 1 << 62)), "long", "drawn", seed=41)
    return _rows(_orders(spark, sf_dir).to_iter().parallel(3, draw), "o_orderkey", "drawn")


@query(f"""WITH n AS (SELECT count(*) AS n FROM ({ROWS})), r AS (SELECT i, o_orderkey, CASE WHEN i < (n // 3 + 1) * (n % 3) THEN i // (n // 3 + 1) ELSE (i - n % 3) // greatest(n // 3, 1) END AS w FROM ({ROWS}), n),
b AS (SELECT w, (row_number() OVER (PARTITION BY w ORDER BY i) - 1) // 64 AS k, (row_number() OVER (PARTITION BY w ORDER BY i) - 1) % 64 AS pos, o_orderkey FROM r),
o AS (SELECT w, k, row_number() OVER (ORDER BY k, w) - 1 AS batch FROM (SELECT DISTINCT w, k FROM b))
SELECT batch, CAST(pos AS BIGINT) AS pos, o_orderkey FROM b JOIN o USING (w, k)""")
def prf_sequential(spark, sf_dir):
    """Three workers, each with a contiguous part."""
    return _unnest(_orders(spark, sf_dir).to_iter().parallel(3, lambda part: part.batch(64), sequential=True))


@query(f"""WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_totalprice > 100000) AS kept FROM ({ROWS}))
SELECT k AS id, ['batch', 'ToIter', 'Filter', 'Shuffle', 'Seeded', 'Source'][k + 1] AS name, CASE WHEN k < 5 THEN [CAST(k + 1 AS INTEGER)] ELSE [] END AS inputs,
  CAST([(kept + 63) // 64, kept, n, n, n, n][k + 1] AS BIGINT) AS elements FROM n, (SELECT CAST(unnest(range(6)) AS INTEGER) AS k)""")
def stats_summary(spark, sf_dir):
    ds = _orders(spark, sf_dir).seed(SEED).shuffle().filter("o_totalprice > 100000").to_iter().batch(64)
    return execution_summary(ds).drop("seconds")
