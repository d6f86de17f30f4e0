"""Pairs of rows that share a band, the most alike first, without a list of all of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Pairs that are held at once.
HELD_PAIRS = 1 << 21
#: Rows up to which buckets of one size are paired together; over it a bucket is paired alone.
FEW_ROWS = 48
#: Pairs whose signatures are gathered at once.
GATHERED = 1 << 14
#: Rows of the two sides of a block of a larger bucket.
SIDE, ACROSS = 256, 1024


class BestFirst:
    """All pairs of rows that share a band, in descending order of equal places, then of i, then of j.

    sig: the signatures as an array of rows. What is held are HELD_PAIRS pairs at most: a pass looks at every pair of every
    bucket, keeps the best of them and, if there are more, is followed by a pass for those behind. Between passes rows
    that need no pair any more leave the buckets, which is what keeps the passes few and short.
    """

    def __init__(self, sig: np.ndarray, bands: int):
        self.sig, (self.n, self.k), self.width = sig, sig.shape, sig.shape[1] // bands
        if self.k * self.n * self.n >= 1 << 62:
            raise ValueError(f"{self.n} rows of one component: their pairs have no number of 62 bits")
        self.bands = bands
        self.buckets = [] if self.n <= FEW_ROWS else [self._band(b) for b in range(bands)]

    def _band(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows by bucket, ascending inside; the bucket of each) of one band."""
        part = self.sig[:, b * self.width : (b + 1) * self.width]
        order = np.lexsort(part.T) if self.n else np.zeros(0, np.int64)
        new = np.ones(self.n, bool)
        for c in range(self.width):
            own = part[order, c]
            new[1:] = own[1:] != own[:-1] if not c else new[1:] | (own[1:] != own[:-1])
        return self._shared(order.astype(np.int32 if self.n < 1 << 31 else np.int64), np.cumsum(new, dtype=np.int64))

    @staticmethod
    def _shared(rows: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without the buckets of a single row; buckets numbered anew."""
        new = np.ones(len(rows), bool)
        new[1:] = bucket[1:] != bucket[:-1]
        at = np.cumsum(new) - 1
        keep = (np.bincount(at) > 1)[at] if len(rows) else new
        return rows[keep], at[keep].astype(np.int32 if len(rows) < 1 << 31 else np.int64)

    def share(self, i, j) -> np.ndarray:
        """Whether rows i and j share a band."""
        equal = self.sig[i] == self.sig[j]
        return equal.reshape(*equal.shape[:-1], self.bands, self.width).all(-1).any(-1)

    def _same(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        equal = self.sig[i] == self.sig[j]
        if self.k % 8 or self.k > 255:
            return np.count_nonzero(equal, axis=1)
        words = equal.view(np.uint64)  # eight places a word, each a byte
        total = words[:, 0].copy()
        for c in range(1, words.shape[1]):
            total += words[:, c]
        return ((total * np.uint64(0x0101010101010101)) >> np.uint64(56)).astype(np.int64)

    def _few(self, rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple]:
        """(i, j, places) of the buckets of few rows."""
        for size in np.unique(sizes[sizes <= FEW_ROWS]).tolist():
            first, (a, b) = starts[sizes == size], np.triu_indices(size, 1)
            step = max(1, GATHERED // len(a))
            for at in range(0, len(first), step):
                held = rows[first[at : at + step, None] + np.arange(size)]
                i, j = held[:, a].ravel(), held[:, b].ravel()
                yield i, j, self._same(i, j)

    def _many(self, rows: np.ndarray, least: Callable[[], int], most: int) -> Iterator[tuple]:
        """(i, j, places) of one bucket of many rows, of pairs with least() to `most` places, block by block."""
        kind = np.uint8 if self.k < 256 else np.int32
        for a in range(0, len(rows), SIDE):
            left = np.ascontiguousarray(self.sig[rows[a : a + SIDE]].T)
            for b in range(a, len(rows), ACROSS):
                right = np.ascontiguousarray(self.sig[rows[b : b + ACROSS]].T)
                shape = (left.shape[1], right.shape[1])
                places, equal = np.zeros(shape, kind), np.empty(shape, bool)
                for x, y in zip(left, right):
                    np.equal(x[:, None], y, out=equal)
                    np.add(places, equal.view(np.uint8), out=places)
                fit = places >= max(1, least())
                if most < self.k:
                    fit &= places <= most
                x, y = np.divmod(np.flatnonzero(fit), shape[1])
                ahead = y + b > x + a
                x, y = x[ahead], y[ahead]
                yield rows[a + x], rows[b + y], places[x, y].astype(np.int64)

    def _pass(self, ceiling: int | None) -> tuple[np.ndarray, bool]:
        """The best pairs below `ceiling` as numbers, ascending, and whether there are more."""
        n, square, held, count, floor, more = self.n, self.n * self.n, [], 0, 0, False
        most = self.k if ceiling is None else ceiling // square

        def best() -> np.ndarray:
            return np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)

        def least() -> int:
            return floor // square

        def found():
            if self.n <= FEW_ROWS:
                i, j = np.triu_indices(self.n, 1)
                shared = self.share(i, j)
                i, j = i[shared], j[shared]
                yield i, j, self._same(i, j)
            for rows, bucket in self.buckets:
                starts = np.flatnonzero(np.diff(bucket, prepend=-1))
                sizes = np.diff(starts, append=len(rows))
                yield from self._few(rows, starts, sizes)
                for k in np.flatnonzero(sizes > FEW_ROWS).tolist():
                    yield from self._many(rows[starts[k] : starts[k] + sizes[k]], least, most)

        for i, j, places in found():
            value = places * square + i.astype(np.int64) * n + j
            fit = value >= floor
            if ceiling is not None:
                fit &= value < ceiling
            value = value[fit]
            held.append(value)
            count += len(value)
            if count > 2 * HELD_PAIRS:
                top = best()
                if len(top) > HELD_PAIRS:
                    top, more = top[-HELD_PAIRS:], True
                    floor = int(top[0])
                held, count = [top], len(top)
        return best(), more

    def pairs(self, needed: Callable[[], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places, i, j) in order, some at a time. needed(): which rows still need pairs, asked before each pass but the first."""
        ceiling, square, more = None, self.n * self.n, True
        while more:
            if ceiling is not None:
                mask = needed()
                self.buckets = [self._shared(rows[mask[rows]], bucket[mask[rows]]) for rows, bucket in self.buckets]
            values, more = self._pass(ceiling)
            ceiling = int(values[0]) if more else None
            for at in range(len(values), 0, -GATHERED):
                own = values[max(0, at - GATHERED) : at][::-1]
                places, key = np.divmod(own, square)
                i, j = np.divmod(key, self.n)
                yield places, i, j
