"""Every query with SQL gives the SQL's rows."""

import oracle
import pytest

from tidewheel import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows(spark, con, name):
    assert not oracle.differences(catalogue.queries()[name](spark, SF), con, catalogue.oracle_sql()[name])


@pytest.mark.parametrize(("name", "most", "align"), [("pck_first_fit", 10**9, 1), ("pck_max_seq", 3, 1), ("pck_align", 10**9, 64)])
def test_first_fit_by_plain_loops(spark, con, name, most, align):
    lengths = [((d, k), n) for d, k, n in con.execute(f"SELECT doc_id, since, n FROM ({catalogue._PIECES}) ORDER BY 1, 2").fetchall()]
    want, done, bins = {}, 0, []
    for doc, n in lengths:
        while True:
            fits = [b for b in bins if b[0] + n <= catalogue.CLIP and b[1] < most]
            if not fits and len(bins) < 8:
                bins.append([0, 0, done + len(bins)])
                fits = bins[-1:]
            if fits:
                break
            done, bins = done + len(bins), []
        b = fits[0]
        want[doc] = (b[1] + 1, b[0], n, b[2])
        b[0], b[1] = -(-(b[0] + n) // align) * align, b[1] + 1
    got = {(r.doc_id, r.since): (r.segment, r.at, r["size"], r.row) for r in catalogue.queries()[name](spark, SF).collect()}
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
