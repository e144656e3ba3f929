"""Queries against plain loops, at sizes where widths, windows and counts of the SQL matter."""

import duckdb
import numpy as np
import oracle
import pytest

from tidewheel import catalogue
from tidewheel.functions.permutation import permute
from tidewheel.functions.schedules import default_seed, element_generators

SF, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.fixture(scope="module")
def keys():
    return [k for (k,) in oracle.connect(LARGE).execute("SELECT o_orderkey FROM orders ORDER BY 1 DESC").fetchall()]


def in_order(df, *columns):
    return [tuple(r) if len(r) > 1 else r[0] for r in df.orderBy("idx").select(*columns).collect()]


def test_every_row_is_read(spark, con):
    for name, table in (("src_table", "events"), ("map_expr", "orders"), ("shf_global", "orders"), ("bat_batch", "orders"), ("itl_interleave", "customer"), ("itl_short_cycle", "customer"), ("shf_hierarchical", "customer")):
        assert catalogue.queries()[name](spark, SF).count() == con.execute(f"SELECT count(*) FROM {table}").fetchone()[0]
    orders, customers = (con.execute(f"SELECT count(*) FROM {t}").fetchone()[0] for t in ("orders", "customer"))
    assert catalogue.queries()["cat_concat"](spark, SF).count() == orders + customers


def test_shuffles_past_the_catalogues_sizes(spark, keys):
    """More rows than a 16-bit block holds, and more than 60 windows."""
    n = len(keys)
    assert n > 1 << 16 and n > 60 * catalogue.WINDOW
    assert in_order(catalogue.queries()["shf_global"](spark, LARGE), "o_orderkey") == [keys[v] for v in permute(np.arange(n), n, catalogue.SHUFFLE_SEED)]
    large = oracle.connect(LARGE)
    for name in ("shf_global", "shf_window_iter", "shf_window_parity", "mix_iter_stop", "prf_sequential"):
        assert not oracle.differences(catalogue.queries()[name](spark, LARGE), large, catalogue.oracle_sql()[name])
    straight, turned = [], []
    for w, lo in enumerate(range(0, n, catalogue.WINDOW)):
        own = keys[lo : lo + catalogue.WINDOW]
        own = [own[v] for v in permute(np.arange(len(own)), len(own), 7 + w)]
        straight += own
        turned += own[::-1]
    assert in_order(catalogue.queries()["shf_window_map"](spark, LARGE), "o_orderkey") == straight
    assert in_order(catalogue.queries()["shf_window_iter"](spark, LARGE), "o_orderkey") == turned


def test_hierarchical_shuffle(spark, con):
    lists = {}
    for nation, key in con.execute("SELECT n_nationkey, c_custkey FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey ORDER BY 1, 2").fetchall():
        lists.setdefault(nation, []).extend([key] if key is not None else [])
    files = [lists[sorted(lists)[v]] for v in permute(range(len(lists)), len(lists), catalogue.SHUFFLE_SEED)]
    merged = [f[j] for j in range(max(map(len, files))) for f in files if j < len(f)]
    want = []
    for w, lo in enumerate(range(0, len(merged), 100)):
        own = merged[lo : lo + 100]
        want += [own[v] for v in permute(np.arange(len(own)), len(own), 7 + w)][::-1]
    assert in_order(catalogue.queries()["shf_hierarchical"](spark, SF), "c_custkey") == want


def test_hierarchical_shuffle_of_more_customers(spark, tmp_path):
    """Three times the customers: their table is scanned once for all nations, and rows of 450 windows come mixed."""
    copies, large = 3, oracle.connect(LARGE)
    large.execute(f"COPY (SELECT * FROM nation) TO '{tmp_path}/nation.parquet'")
    large.execute(f"COPY (SELECT c.* REPLACE (c_custkey + r * 1000000 AS c_custkey) FROM customer c, range({copies}) t(r) WHERE c_custkey <> r) TO '{tmp_path}/customer.parquet'")
    df = catalogue.queries()["shf_hierarchical"](spark, str(tmp_path))
    assert df._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 1
    here = duckdb.connect()
    rows = f"SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS j FROM '{tmp_path}/customer.parquet'"
    nations = [k for (k,) in here.execute(f"SELECT n_nationkey FROM '{tmp_path}/nation.parquet' ORDER BY 1").fetchall()]
    slot = {nations[k]: i for i, k in enumerate(permute(range(len(nations)), len(nations), catalogue.SHUFFLE_SEED))}
    merged = [r[1] for r in sorted(here.execute(rows).fetchall(), key=lambda r: (r[2], slot[r[0]]))]
    assert len(merged) % 100
    want = []
    for w, lo in enumerate(range(0, len(merged), 100)):
        own = merged[lo : lo + 100]
        want += [own[v] for v in permute(np.arange(len(own)), len(own), 7 + w)][::-1]
    assert in_order(df, "c_custkey") == want


def test_random_map_and_summary(spark, con):
    keys = [k for (k,) in con.execute("SELECT o_orderkey FROM orders ORDER BY 1 DESC").fetchall()]
    pool = element_generators(default_seed([(41, 1)]))
    assert in_order(catalogue.queries()["random_map"](spark, SF), "o_orderkey", "drawn") == [(k, int(pool(i).integers(0, 1000))) for i, k in enumerate(keys)]
    drawn = in_order(catalogue.queries()["random_map_workers"](spark, SF), "o_orderkey", "drawn")
    pool = element_generators(41)
    assert drawn == [(k, int(pool(i).integers(0, 1 << 62))) for i, k in enumerate(keys)] and len({d for _, d in drawn}) == len(keys)
    kept = con.execute("SELECT count(*) FROM orders WHERE o_totalprice > 100000").fetchone()[0]
    assert [r.elements for r in catalogue.queries()["stats_summary"](spark, SF).orderBy("id").collect()][0] == -(-kept // 64)


def test_every_word_is_packed(spark, con):
    """Texts longer than a row keep their tails, and no word has two places."""
    sizes = dict(con.execute("SELECT doc_id, len(string_split(text, ' ')) FROM documents").fetchall())
    assert max(sizes.values()) > 3 * catalogue.CLIP
    for name in ("first_fit", "best_fit", "max_seq", "align", "workers"):
        words, cells, n = set(), set(), 0
        for r in catalogue.queries()[f"pck_{name}"](spark, SF).collect():
            assert r.at + r["size"] <= catalogue.CLIP
            words |= {(r.doc_id, r.since + k) for k in range(r["size"])}
            cells |= {(r.row, r.at + k) for k in range(r["size"])}
            n += r["size"]
        assert words == {(d, k) for d, size in sizes.items() for k in range(size)} and len(cells) == n == len(words)
    for name in ("pck_concat_split_bos", "pck_and_batch"):
        assert sum(r.used for r in catalogue.queries()[name](spark, SF).collect()) == sum(sizes.values())
    cut = catalogue.queries()["pck_concat_split"](spark, SF).collect()
    assert sum(r["size"] for r in cut) == sum(sizes.values()) and max(sum(r.doc_id == d for r in cut) for d in (max(sizes, key=sizes.get),)) >= 3


def test_gathers_reach_every_row(spark, con):
    got = [r.o_orderkey for r in catalogue.queries()["idx_reindex"](spark, SF).collect()]
    assert sorted(got) == [k for (k,) in con.execute("SELECT o_orderkey FROM orders ORDER BY 1").fetchall()]
