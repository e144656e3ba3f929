"""Known values of the kernels, and properties that hold for all inputs."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewheel.functions import bins, permutation, schedules
from tidewheel.functions.permutation import index_shuffle, permute


def test_shuffle_known_order():
    seed = schedules.default_seed([(42, 1)])
    assert seed == 3329053876
    assert permute(range(10), 10, seed).tolist() == [1, 7, 6, 9, 0, 8, 4, 5, 3, 2]


@pytest.mark.parametrize("n", [1, 2, 3, 1000, 46205, 65536, 65537, 262145])
def test_shuffle_is_a_bijection_with_an_inverse(n):
    p = permute(np.arange(n), n, 52)
    assert len(np.unique(p)) == n and p.min() == 0 and p.max() == n - 1
    assert (permute(p, n, 52, inverse=True) == np.arange(n)).all()
    assert index_shuffle(0, n - 1, 52) == p[0]


@pytest.mark.parametrize("n", [1, 20, 100, 256, 257, 1000, 16385, 65535, 65536, 65537, 10**6])
def test_shuffles_of_many_seeds_go_side_by_side(monkeypatch, n):
    """The values of one seed after the other, without a table for each, by bytes as well as by look-ups."""
    rng = np.random.default_rng(n)
    seeds = rng.integers(0, 1 << 32, 40)
    which, x = rng.integers(0, 40, 300), rng.integers(0, n, 300)
    want = {inverse: [int(permute([v], n, int(seeds[w]), inverse=inverse)[0]) for v, w in zip(x, which)] for inverse in (False, True)}
    monkeypatch.setattr(permutation, "table", None)
    monkeypatch.setattr(permutation, "_inverse_table", None)
    for few in (0, 60, 1000):
        monkeypatch.setattr(permutation, "FEW", few)
        for inverse in (False, True):
            assert permute(x, n, seeds[which], inverse=inverse).tolist() == want[inverse]


@pytest.mark.parametrize("bad", [(-1, 5, 1, 4), (6, 5, 1, 4), (0, 5, 1 << 32, 4), (0, 5, 1, 5), (0, 5, 1, 2)])
def test_shuffle_arguments(bad):
    with pytest.raises(ValueError):
        permute([0], 100000, 1, bad[3]) if bad[3] != 4 else index_shuffle(*bad)


def test_random_map_known_values():
    pool = schedules.element_generators(schedules.default_seed([(41, 1)]))
    assert [i + int(pool(i).integers(0, 10)) for i in range(10)] == [0, 6, 9, 5, 10, 14, 14, 13, 15, 13]


def laid_out(sizes, cycle):
    places = {at + k * by: (i, lo + k) for i, lo, n, at, by in schedules.interleave_runs(sizes, cycle).tolist() for k in range(n)}
    assert sorted(places) == list(range(sum(sizes)))
    return [places[k] for k in sorted(places)]


def test_interleave_known_orders():
    assert [i + 1 for i, _ in laid_out([1, 2, 3, 4, 5], 3)] == [1, 2, 3, 2, 3, 4, 3, 4, 5, 4, 5, 4, 5, 5, 5]


@given(st.lists(st.integers(0, 7), max_size=8), st.integers(1, 9))
@settings(max_examples=80, deadline=None)
def test_interleave_by_a_plain_loop(sizes, cycle):
    waiting, slots, at, want = list(range(len(sizes))), [None] * min(cycle, len(sizes)), [0] * len(sizes), []
    while waiting or any(s is not None for s in slots):
        for k, _ in enumerate(slots):
            if slots[k] is None and waiting:
                slots[k] = waiting.pop(0)
            i = slots[k]
            if i is not None and at[i] < sizes[i]:
                want.append((i, at[i]))
                at[i] += 1
            else:
                slots[k] = None
    assert laid_out(sizes, cycle) == want


def test_runs_follow_inputs_not_rows():
    assert len(schedules.interleave_runs([10**12 + k for k in range(50)], 4)) < 1000


@given(st.lists(st.integers(1, 50), min_size=1, max_size=4), st.integers(0, 300))
@settings(max_examples=60, deadline=None)
def test_mix_takes_inputs_by_their_parts(parts, k):
    """Each position takes one row, of one input, and no input strays from its share by a whole row for each before it."""
    before = [schedules.taken(k, parts, i) for i in range(len(parts))]
    after = [schedules.taken(k + 1, parts, i) for i in range(len(parts))]
    assert sum(before) == k and sorted(b - a for a, b in zip(before, after, strict=True)) == [0] * (len(parts) - 1) + [1]
    assert all(abs(n - k * p / sum(parts)) <= len(parts) for n, p in zip(before, parts, strict=True))


@given(st.integers(0, 100), st.integers(1, 9), st.booleans())
@settings(max_examples=60, deadline=None)
def test_even_split(n, c, drop):
    ranges = [schedules.even_split(n, schedules.Shard(s, c, drop)) for s in range(c)]
    assert sum(b - a for a, b in ranges) == (n // c * c if drop else n)
    assert max(b - a for a, b in ranges) - min(b - a for a, b in ranges) <= (0 if drop else 1)


def _bins(lengths, capacity, n, best=False, **how):
    p = bins.BinPacker([capacity], n, best, **how)
    out = [x for i, size in enumerate(lengths) for x in p.place(i, [size])] + list(p.flush())
    rows: dict = {}
    for i, row, *_ in out:
        rows.setdefault(row, []).append(i)
    return [rows[k] for k in sorted(rows)]


def test_bins_known():
    assert _bins([4, 8, 2], 10, 2) == [[0, 2], [1]]
    assert _bins([4, 8, 2], 10, 2, best=True) == [[0], [1, 2]]
    assert _bins([50, 70, 25, 40], 100, 3, best=True) == [[0, 3], [1, 2]]
    assert _bins([1, 1, 1], 10, 2, most=2) == [[0, 1], [2]]
    with pytest.raises(ValueError):
        _bins([11], 10, 2)


@given(st.lists(st.integers(1, 20), max_size=60), st.integers(1, 5), st.booleans())
@settings(max_examples=60, deadline=None)
def test_bins_against_a_plain_loop(lengths, n, best):
    rows, open_ = [], []
    for i, size in enumerate(lengths):
        fits = [b for b in open_ if sum(lengths[x] for x in b) + size <= 20]
        fits = sorted(fits, key=lambda b: (-sum(lengths[x] for x in b) if best else 0, open_.index(b)))
        # An empty bin is one more choice, the last and least full.
        if fits:
            fits[0].append(i)
        elif len(open_) < n:
            open_.append([i])
        else:
            rows += open_
            open_ = [[i]]
    assert _bins(lengths, 20, n, best) == rows + open_


def test_rows_of_a_batch_sorted_by_a_feature():
    p = bins.BinPacker([3], 4, shuffle_bins=True, seed=5)
    out = [x for i, v in enumerate([[2.0, 0.0], [0.0], [1.0, 1.0], [4.0, 2.0]]) for x in p.place(i, [3], v)] + list(p.flush())
    assert [i for i, *_ in sorted(out, key=lambda x: x[1])] == [1, 2, 0, 3]
    ties = bins.BinPacker([3], 4, shuffle_bins=True, seed=5)
    out = [x for i in range(4) for x in ties.place(i, [3], [7.0])] + list(ties.flush())
    order = np.random.default_rng(5).permuted(np.arange(4))
    assert [i for i, *_ in sorted(out, key=lambda x: x[1])] == np.lexsort((order, np.full(4, 7.0))).tolist()


@given(st.lists(st.integers(0, 40), max_size=20))
@settings(max_examples=60, deadline=None)
def test_cuts_keep_every_token(lengths):
    stream = [(i, k) for i, n in enumerate(lengths) for k in range(n)]
    got: dict = {}
    for i, row, _, at, since, n in bins.cut_stream([(i, [n]) for i, n in enumerate(lengths)], [7]):
        for k in range(n[0]):
            got[(row, at[0] + k)] = (i, since[0] + k)
    assert [got[k] for k in sorted(got)] == stream
    assert all(row * 7 + c == x for x, (row, c) in enumerate(sorted(got)))
