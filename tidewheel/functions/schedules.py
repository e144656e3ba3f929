"""Integer schedules that need no rows: mixing, even splits, interleaving, seeds."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np


def proportions(weights: Sequence[float] | None, n: int) -> list[int]:
    """Whole-number parts of a mix: weights over the smallest, in hundredths; equal parts without weights."""
    if weights is None:
        return [1] * n
    if len(weights) != n:
        raise ValueError("as many weights as inputs are needed")
    if any(w <= 0 for w in weights):
        raise ValueError("weights must be positive")
    low = min(weights)
    return [int(w * (100 / low)) for w in weights]


def taken(k: int, parts: Sequence[int], which: int) -> int:
    """Rows that an input has given among the first k of a mix."""
    rest = sum(parts)
    for i, p in enumerate(parts):
        left = k * (rest - p) // rest
        if i == which:
            return k - left
        k, rest = left, rest - p
    raise IndexError(which)


def mix_length(lengths: Sequence[int], parts: Sequence[int]) -> int:
    total = sum(parts)
    if any(n == 0 for n in lengths):
        raise ValueError("an input of a mix is empty")
    return int(min(n / (p / total) for n, p in zip(lengths, parts, strict=True)))


@dataclass(frozen=True)
class Shard:
    """One of several equal parts of an input."""

    index: int = 0
    count: int = 1
    drop_remainder: bool = False

    def __post_init__(self):
        if self.count < 1 or not 0 <= self.index < self.count:
            raise ValueError("a shard's index must be in [0, count)")


def even_split(n: int, shard: Shard) -> tuple[int, int]:
    """The contiguous range of a shard; the first ones take the remainder unless it is dropped."""
    q, r = divmod(n, shard.count)
    s = shard.index
    if shard.drop_remainder:
        return q * s, q * (s + 1)
    return q * s + min(s, r), q * (s + 1) + min(s + 1, r)


def interleave_runs(sizes: Sequence[int], cycle: int) -> np.ndarray:
    """Runs (input, first row, rows, first place, stride) of a round robin over at most `cycle` open inputs.

    A slot whose input has ended gives nothing that turn and opens the next input at its next visit. Between two
    such events all turns are alike, so there are as many runs as slots for each event, whatever the rows.
    """
    if cycle < 1:
        raise ValueError("cycle_length must be positive")
    open_: list[int | None] = [None] * min(cycle, len(sizes))
    given, waiting, place, runs = [0] * len(sizes), iter(range(len(sizes))), 0, []
    upcoming = next(waiting, None)
    while upcoming is not None or any(i is not None for i in open_):
        rests = [sizes[i] - given[i] if i is not None else None for i in open_]
        regular = all(r if r is not None else upcoming is None for r in rests)
        turns = min(r for r in rests if r is not None) if regular else 1
        live = [s for s, r in enumerate(rests) if r] if regular else []
        for k, slot in enumerate(live):
            i = open_[slot]
            runs.append((i, given[i], turns, place + k, len(live)))
            given[i] += turns
        place += turns * len(live)
        for slot in () if regular else range(len(open_)):
            if open_[slot] is None and upcoming is not None:
                open_[slot], upcoming = upcoming, next(waiting, None)
            i = open_[slot]
            if i is not None and given[i] < sizes[i]:
                runs.append((i, given[i], 1, place, 1))
                given[i], place = given[i] + 1, place + 1
            else:
                open_[slot] = None
    return np.array(runs, np.int64).reshape(-1, 5)


def default_seed(pairs: Sequence[tuple[int, int]]) -> int:
    """One seed from (seed, distance) pairs."""
    flat = [x for pair in pairs for x in pair]
    return int(np.random.SeedSequence(flat).generate_state(1, np.uint32)[0])


def element_generators(seed: int) -> Callable[..., np.random.Generator]:
    """element index (and operation) -> its own generator: one Philox key for the seed, the element as counter."""
    if not 0 <= seed < 1 << 32:
        raise ValueError("seed must be in [0, 2**32)")
    key = np.random.Philox(seed).state["state"]["key"]
    return lambda index, op_seed=0: np.random.Generator(np.random.Philox(key=key, counter=np.array([0, 0, op_seed, index], np.uint64)))
