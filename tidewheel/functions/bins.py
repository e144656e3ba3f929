"""Assignment of elements to bins: first fit, best fit, and cuts of a concatenated stream. Lengths only."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np


class BinPacker:
    """Fills bins of one batch at a time. place() takes an element's lengths and gives finished batches.

    A batch ends at the element for which no bin has room, and that element begins the next one with empty bins: so a
    batch follows from its first element alone, which `batch_starts` and the packing operator rest on.
    best: of the bins with room, the fullest; else the first. align: used cells round up to multiples.
    shuffle_bins: rows of a batch come in a seeded order; elements may carry values (numbers of one feature), and
    then rows are sorted by the mean of their distinct values other than zero, in the seeded order where they tie.
    """

    def __init__(self, capacity: Sequence[int], bins: int, best: bool = False, align: Sequence[int] | None = None, most: int | None = None, seed: int = 0, shuffle_bins: bool = False, emitted: int = 0):
        if bins < 1 or any(c < 1 for c in capacity):
            raise ValueError("bins and capacities must be positive")
        self.capacity, self.bins, self.best = np.asarray(capacity, np.int64), bins, best
        self.align = np.asarray(align if align is not None else [1] * len(self.capacity), np.int64)
        self.most, self.seed, self.shuffle_bins = most or np.iinfo(np.int64).max, seed, shuffle_bins
        self.limit, self.step = int(self.capacity[0]), int(self.align[0])
        #: Rows of the batches before.
        self.emitted = emitted
        self._clear()

    def _clear(self) -> None:
        one = len(self.capacity) == 1  # plain lists are quicker for the usual few bins of one feature
        self.used = [0] * self.bins if one else np.zeros((self.bins, len(self.capacity)), np.int64)
        self.count = [0] * self.bins if one else np.zeros(self.bins, np.int64)
        self.held: list[tuple] = []
        self.values: dict[int, set] = {}

    def put(self, idx: int, lengths: Sequence[int]) -> tuple[int, list[int]] | None:
        """Takes an element into a bin (its number and what it had used before), or None if no bin has room."""
        if len(self.capacity) == 1:
            return self._put_one(idx, int(lengths[0]))
        size = np.asarray(lengths, np.int64)
        if (size > self.capacity).any():
            raise ValueError(f"element {idx} is longer than a bin: {list(lengths)}")
        fits = (self.used + size <= self.capacity).all(1) & (self.count < self.most)
        if not fits.any():
            return None
        at = int(np.argmax(np.where(fits, self.used.sum(1), -1))) if self.best else int(np.argmax(fits))
        self.count[at] += 1
        before = self.used[at].tolist()
        self.used[at] = -(-(self.used[at] + size) // self.align) * self.align
        return at, before

    def _put_one(self, idx: int, size: int) -> tuple[int, list[int]] | None:
        if size > self.limit:
            raise ValueError(f"element {idx} is longer than a bin: {[size]}")
        room, at, top = self.limit - size, -1, -1
        for b, used in enumerate(self.used):
            if used <= room and used > top and self.count[b] < self.most:
                at, top = b, used
                if not self.best:
                    break
        if at < 0:
            return None
        self.count[at] += 1
        self.used[at] = -(-(top + size) // self.step) * self.step
        return at, [top]

    def place(self, idx: int, lengths: Sequence[int], values: Sequence[float] | None = None) -> Iterator[tuple]:
        found = self.put(idx, lengths)
        if found is None:
            if not self.held:
                raise ValueError(f"element {idx} fits no empty bin")
            yield from self.flush()
            found = self.put(idx, lengths)
        at, before = found
        if values is not None:
            self.values.setdefault(at, set()).update(values)
        self.held.append((idx, at, int(self.count[at]), before, [int(n) for n in lengths]))

    def rows(self) -> int:
        """Rows of the open batch."""
        return int(np.count_nonzero(self.count))

    def batch_starts(self, elements: Iterable[tuple[int, Sequence[int]]]) -> Iterator[tuple[int, int]]:
        """(first element, rows of the batch before it) of each batch after the one that the first element begins; places nothing."""
        self._clear()
        for idx, lengths in elements:
            if self.put(idx, lengths) is None:
                rows = self.rows()
                self._clear()
                if self.put(idx, lengths) is None:
                    raise ValueError(f"element {idx} fits no empty bin")
                yield idx, rows

    def flush(self) -> Iterator[tuple]:
        """(idx, out row, segment from 1, starts, lengths) of the open batch."""
        rows = self.rows()
        order = np.arange(rows)
        if self.shuffle_bins and rows:
            order = np.random.default_rng(self.seed + self.emitted).permuted(order)
            if self.values:
                kinds = [[v for v in self.values.get(k, ()) if v] for k in range(rows)]
                means = np.array([sum(v) / len(v) if v else 0.0 for v in kinds])
                order = np.lexsort((order, means))
        place = np.empty(rows, np.int64)
        place[order] = np.arange(rows)
        for idx, at, segment, starts, size in self.held:
            yield idx, self.emitted + int(place[at]), segment, starts, size
        self.emitted += rows
        self._clear()


def cut_stream(elements: Iterable[tuple[int, Sequence[int]]], target: Sequence[int], split_full: bool = True) -> Iterator[tuple[int, int, int, list[int], list[int], list[int]]]:
    """(idx, out row, segment from 1, starts in the row, starts in the element, lengths): concatenated, then cut where any feature is full.

    Every feature of an element is cut at its own free space, and its rest goes on in the next row.
    With split_full=False an element exactly at a target, none above, is a row of its own, which
    comes after the row that is open then.
    """
    target_ = np.asarray(target, np.int64)
    row, used, segment = 0, np.zeros(len(target_), np.int64), 0
    for idx, lengths in elements:
        left = np.asarray(lengths, np.int64)
        at = np.zeros_like(left)
        if not split_full and (left == target_).any() and (left <= target_).all():
            row += 1 if segment else 0
            yield idx, row, 1, [0] * len(left), at.tolist(), left.tolist()
            row, used, segment = row + 1, np.zeros_like(used), 0
            continue
        fresh = True
        while fresh or left.any():
            fresh = False
            if (used + left <= target_).all():
                piece = left
            else:
                piece = np.minimum(left, target_ - used)
            if piece.any() or not left.any():
                segment += 1
                yield idx, row, segment, used.tolist(), at.tolist(), piece.tolist()
            used, at, left = used + piece, at + piece, left - piece
            if left.any() or (used == target_).any():
                row, used, segment = row + 1, np.zeros_like(used), 0
