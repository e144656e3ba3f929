"""First fit and best fit in parallel blocks against one packer over the whole sequence."""

import json

import numpy as np
import pytest

from tidewheel.cursor import Cursor
from tidewheel.functions.bins import BinPacker
from tidewheel.operators.packing import assign_bins
from tidewheel.pipeline import IterPipeline


def frame(spark, lengths):
    return spark.createDataFrame([(i, [int(x) for x in n]) for i, n in enumerate(lengths)], "_idx long, len array<long>").repartition(5)


def one_task(lengths, capacity, bins, best, workers, **options):
    parts = []
    for w in range(workers):
        p, out = BinPacker(capacity, bins, best, **options), []
        for i in range(w, len(lengths), workers):
            out += p.place(i, lengths[i])
        parts.append([*out, *p.flush()])
    rows = {(w, r) for w, part in enumerate(parts) for _, r, *_ in part}
    order = {k: i for i, k in enumerate(sorted(rows, key=lambda k: (k[1], k[0])))}
    return sorted((i, order[(w, r)], s, [int(a) for a in at], list(map(int, n))) for w, part in enumerate(parts) for i, r, s, at, n in part)


def placed(df):
    return sorted((r["_idx"], r["row"], r["segment"], r["at"], r["size"]) for r in df.collect())


CASES = [  # features, capacity, bins, lengths up to, block, options
    (1, [64], 4, 40, 64, {}), (1, [64], 4, 40, 64, {"best": True}), (2, [64, 30], 5, 25, 128, {"align": [8, 1], "most": 3}), (1, [64], 3, 40, 32, {"shuffle_bins": True, "seed": 7}),
    (1, [64], 4, 40, 64, {"workers": 3}), (1, [64], 8, 3, 16, {}), (1, [512], 30, 512, 256, {"workers": 2, "best": True, "shuffle_bins": True}), (1, [10], 1, 10, 8, {}),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_blocks_give_the_rows_of_one_task(spark, case):
    features, capacity, bins, longest, block, options = CASES[case]
    rng = np.random.default_rng(case)
    lengths = rng.integers(0, longest + 1, (700, features)) if features > 1 else rng.integers(1, longest + 1, (700, 1))
    how = {"best": False, "workers": 1, **options}
    assert placed(assign_bins(frame(spark, lengths), capacity, bins, block=block, **how)) == one_task(lengths, capacity, bins, **how)


@pytest.mark.parametrize("kind", ["alike", "never meeting", "long batches", "few", "none"])
def test_sequences_of_every_kind(spark, kind):
    # Elements of one length never let two runs meet unless they start alike; tiny ones make a batch longer than blocks.
    lengths = {"alike": [[4]] * 700, "never meeting": [[7]] * 500, "long batches": [[1]] * 900, "few": [[3]] * 2, "none": []}[kind]
    capacity, bins = ([64], 8) if kind == "long batches" else ([7], 3)
    assert placed(assign_bins(frame(spark, lengths), capacity, bins, block=64)) == one_task(lengths, capacity, bins, False, 1)


def test_cursors_go_on_from_a_mark(spark):
    rng = np.random.default_rng(1)
    rows = [(i, list(range(int(n)))) for i, n in enumerate(rng.integers(1, 40, 3000))]
    df = spark.createDataFrame(rows, "_idx long, token array<int>").repartition(4)
    make = lambda: IterPipeline.source(df).map(token="token").pack({"token": 64}, 4, block=128, seed=3).batch(5, pad={})
    whole = make().frame().orderBy("_idx").collect()
    cursor = Cursor(make())
    for _ in range(len(whole) - 3):
        next(cursor)
    state = json.loads(json.dumps(cursor.get_state()))
    ((row, element),) = state["marks"]
    assert 0 < (len(whole) - 3) * 5 - row < 200 and element > 2700  # near the place, and near the end of the source
    again = Cursor(make())
    again.set_state(state)
    assert list(again) == [type(r)(**{k: v for k, v in r.asDict().items() if k != "_idx"}) for r in whole[-3:]]
    assert again._ds._parents[0]._parents[0].frame_from(element).count() == 3000 - element  # what the source is asked for


def test_elements_longer_than_a_bin_are_an_error(spark):
    with pytest.raises(Exception, match="longer than a bin"):
        assign_bins(frame(spark, [[3], [9]]), [8], 2).collect()
