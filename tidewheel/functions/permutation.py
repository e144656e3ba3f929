"""A seeded bijection of [0, n): a four-round half-block cipher, walked until its value falls in range.

Vectorised over NumPy arrays, both ways. The inverse lets a shuffle move rows to their new places without
looking anything up. Small domains walk long, so up to TABLE values of one seed use a table built once; values of
many seeds walk side by side, each with its own keys.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np

TABLE = 1 << 14
#: Values of many seeds from which on a walk goes by bytes; fewer by look-ups.
FEW = 4096
MASK32 = 0xFFFFFFFF


def seed_words(seed: int | np.ndarray, n: int) -> list:
    """n 32-bit words of the standard seed sequence made of one seed word (ISO C++, rand.util.seedseq); seed: a number, or 64-bit words of which each has its own."""
    v = [seed & MASK32]
    s, out = len(v), [0x8B8B8B8B] * n
    t = 11 if n >= 623 else 7 if n >= 68 else 5 if n >= 39 else 3 if n >= 7 else (n - 1) // 2
    p = (n - t) // 2
    q = p + t
    m = max(s + 1, n)

    def stir(x):
        return x ^ (x >> 27)

    for k in range(m):
        r1 = (1664525 * stir(out[k % n] ^ out[(k + p) % n] ^ out[(k - 1) % n])) & MASK32
        r2 = (r1 + (s if k == 0 else (k % n) + (v[k - 1] if k <= s else 0))) & MASK32
        out[(k + p) % n] = (out[(k + p) % n] + r1) & MASK32
        out[(k + q) % n] = (out[(k + q) % n] + r2) & MASK32
        out[k % n] = r2
    for k in range(m, m + n):
        r3 = (1566083941 * stir((out[k % n] + out[(k + p) % n] + out[(k - 1) % n]) & MASK32)) & MASK32
        r4 = (r3 - k % n) & MASK32
        out[(k + p) % n] = out[(k + p) % n] ^ r3
        out[(k + q) % n] = out[(k + q) % n] ^ r4
        out[k % n] = r4
    return out


def half_bits(max_index: int) -> int:
    """Half of an even block that holds max_index, of 16 bits at least."""
    b = max(max_index.bit_length(), 16)
    return (b + b % 2) // 2


def round_keys(seed: int | np.ndarray, width: int, rounds: int = 4) -> list:
    if rounds < 4 or rounds > 1024 or rounds % 2:
        raise ValueError("rounds must be even, from 4 to 1024")
    return [k & ((1 << width) - 1) for k in seed_words(seed, rounds)]


def _turn(x: np.ndarray, width: int) -> np.ndarray:
    word = x.dtype.type

    def rot(r: int) -> np.ndarray:
        r %= width
        return ((x << word(r)) | (x >> word(width - r))) & word((1 << width) - 1) if r else x

    return (rot(1) & rot(8)) ^ rot(2)


#: Of halves of 8 bits, by value.
_TURNED = _turn(np.arange(256), 8)


def _turn_bytes(x: np.ndarray) -> np.ndarray:
    """_turn of halves of 8 bits held as bytes, which need no mask: in few operations on whole arrays."""
    once = x + x
    once |= x >> np.uint8(7)
    twice = once + once
    twice |= once >> np.uint8(7)
    once &= x
    once ^= twice
    return once


def _step(left: np.ndarray, right: np.ndarray, keys: list, inverse: bool, turn: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The cipher, or with inverse back; keys are numbers or arrays with one for each value."""
    if inverse:
        for a, b in zip(keys[-2::-2], keys[::-2], strict=True):
            right = right ^ b
            right ^= turn(left)
            left = left ^ a
            left ^= turn(right)
    else:
        for a, b in zip(keys[::2], keys[1::2], strict=True):
            left = left ^ a
            left ^= turn(right)
            right = right ^ b
            right ^= turn(left)
    return left, right


def _walk(x: np.ndarray, n: int, keys: list, width: int, inverse: bool) -> np.ndarray:
    """The first value below n that each x comes to, in a block of which n takes more than a quarter."""
    mask, keys = np.uint64((1 << width) - 1), [np.uint64(k) for k in keys]

    def step(v: np.ndarray, keys: list) -> np.ndarray:
        left, right = _step(v >> np.uint64(width), v & mask, keys, inverse, lambda x: _turn(x, width))
        return (left << np.uint64(width)) | right

    out = step(x.astype(np.uint64), keys)
    while len(far := np.flatnonzero(out >= np.uint64(n))):
        out[far] = step(out[far], [k[far] if k.ndim else k for k in keys])
    return out.astype(np.int64)


def _long_walk(x: np.ndarray, n: int, keys: list, inverse: bool) -> np.ndarray:
    """As _walk, in the smallest block, of 16 bits, where n may be any small part.

    All go side by side as bytes, and those that have arrived go on with the others until they are an eighth of all:
    a step costs less than leaving them out. The last FEW take table look-ups, which are fewer operations.
    """
    out, at, arrived = np.full(len(x), -1, np.int64), np.arange(len(x)), 0
    state, turn = [part.astype(np.uint8) for part in (x >> 8, x & 255, *keys)], _turn_bytes
    high, low = divmod(n, 256)
    while len(at):
        if len(at) <= FEW and turn is _turn_bytes:
            state, turn = [part.astype(np.int64) for part in state], _TURNED.__getitem__
        left, right = state[:2] = _step(*state[:2], state[2:], inverse, turn)
        below = left == high
        below &= right < low
        if high:
            below |= left < high
        here = below.nonzero()[0]
        if not len(here):
            continue
        here = here[out[at[here]] < 0]
        out[at[here]] = (left[here].astype(np.int64) << 8) | right[here]
        arrived += len(here)
        if arrived * 8 >= len(at):
            far = out[at] < 0
            at, state, arrived = at[far], [part[far] for part in state], 0
    return out


@lru_cache(maxsize=256)
def table(n: int, seed: int, rounds: int = 4) -> np.ndarray:
    """permutation of range(n) for n <= TABLE, by following cycles through the whole block once."""
    width = half_bits(n - 1)
    v = np.arange(1 << (2 * width))
    left, right = _step((v >> width).astype(np.uint8), (v & 255).astype(np.uint8), [np.uint8(k) for k in round_keys(seed, width, rounds)], False, _turn_bytes)
    block = (left.astype(np.int64) << width) | right
    out = block[:n].copy()
    while len(far := np.flatnonzero(out >= n)):
        out[far] = block[out[far]]
    return out


@lru_cache(maxsize=256)
def _inverse_table(n: int, seed: int, rounds: int = 4) -> np.ndarray:
    out = np.empty(n, np.int64)
    out[table(n, seed, rounds)] = np.arange(n)
    return out


def permute(x, n: int, seed: int | np.ndarray, rounds: int = 4, inverse: bool = False) -> np.ndarray:
    """Where each x of [0, n) goes, or with inverse where it comes from; seed: of all, or an array with one for each x."""
    x = np.asarray(x, np.int64)
    if n <= 1 or not len(x):
        return np.zeros(len(x), np.int64)
    width = half_bits(n - 1)
    if isinstance(seed, np.ndarray):
        if (seed != seed[0]).any():  # a table for each seed would be made for the few of its values that are here
            seeds, which = np.unique(seed & MASK32, return_inverse=True)
            keys = [k[which] for k in round_keys(seeds.astype(np.uint64), width, rounds)]
            return _long_walk(x, n, keys, inverse) if width == 8 else _walk(x, n, keys, width, inverse)
        seed = int(seed[0])
    if n <= TABLE:
        return (_inverse_table if inverse else table)(n, seed & MASK32, rounds)[x]
    return _walk(x, n, round_keys(seed & MASK32, width, rounds), width, inverse)


def index_shuffle(index: int, max_index: int, seed: int, rounds: int = 4) -> int:
    """One value of the bijection of [0, max_index]."""
    if index < 0 or max_index < 0 or index > max_index or not 0 <= seed <= MASK32:
        raise ValueError("index, max_index or seed is out of range")
    return int(permute([index], max_index + 1, seed, rounds)[0])
