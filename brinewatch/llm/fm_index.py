"""An FM-index over one shard of words: suffix order, wavelet matrix, backward search, sampled positions.

All steps work on numpy arrays and on all patterns at once. Symbol 0 separates runs of words; it never
occurs in a pattern, and each separator counts as different from every other, so suffixes are compared
within their own run only.
"""

from __future__ import annotations

import numpy as np

#: Every such text position has its place in the suffix order kept; others walk back to one.
SAMPLE = 8


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order, by prefix doubling over the groups that are still tied."""
    n = len(text)
    apart = text == 0
    rank = text.astype(np.int64) + int(apart.sum())
    rank[apart] = np.arange(int(apart.sum()))
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        ordered = rank[order]
        new = np.empty(n, bool)
        new[:1], new[1:] = True, ordered[1:] != ordered[:-1]
        group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order] = group
        last = np.append(new[1:], True)
        tied = np.flatnonzero(~(new & last))
        if not len(tied):
            return order
        at = order[tied]
        ahead = at + step
        follow = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        again = np.argsort(group[tied] * (n + 1) + follow, kind="stable")
        order[tied] = at[again]
        key = (group[tied] * (n + 1) + follow)[again]
        # New ranks: a group's first place plus the place within it where the key changes.
        change = np.empty(len(key), bool)
        change[:1], change[1:] = True, key[1:] != key[:-1]
        rank[order[tied]] = tied[np.maximum.accumulate(np.where(change, np.arange(len(key)), 0))]
        step *= 2


class WaveletMatrix:
    """Rank queries on a sequence of integers, one bit level after another."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        rest = values
        for level in reversed(range(self.levels)):
            bit = (rest >> level) & 1
            count = np.zeros(len(rest) + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(rest) - int(count[-1]))
            rest = np.concatenate([rest[bit == 0], rest[bit == 1]])

    def descend(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where ``place`` ends up for ``symbol``; differences of two places are counts of the symbol."""
        for i, level in enumerate(reversed(range(self.levels))):
            one = self.ones[i][place]
            place = np.where((symbol >> level) & 1, self.zeros[i] + one, place - one)
        return place

    def symbol_at(self, place: np.ndarray) -> np.ndarray:
        found = np.zeros(len(place), np.int64)
        for i in range(self.levels):
            one = self.ones[i][place]
            bit = self.ones[i][place + 1] - one
            found = found * 2 + bit
            place = np.where(bit, self.zeros[i] + one, place - one)
        return found


class FmIndex:
    """Count and locate word sequences in ``text`` (integers from 0 to ``symbols`` - 1)."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = SAMPLE):
        text = np.append(text, 0)
        order = suffix_order(text)
        self.wavelet = WaveletMatrix(text[order - 1].astype(np.int64), symbols)
        counts = np.bincount(text, minlength=symbols)
        self.before = np.concatenate([[0], np.cumsum(counts)])[:-1]
        every = np.arange(symbols)
        self.origin = self.wavelet.descend(every, np.zeros(symbols, np.int64))
        # Sampled: every n-th position, and the first of each run, so that no walk crosses a separator.
        keep = np.arange(len(text)) % sample == 0
        keep[0] = True
        keep[1:] |= text[:-1] == 0
        kept = keep[order]
        self.sampled = np.zeros(len(text) + 1, np.int64)
        np.cumsum(kept, out=self.sampled[1:])
        self.positions = order[kept]
        self.size = len(text)

    def _step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.before[symbol] + self.wavelet.descend(symbol, row) - self.origin[symbol]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges ``[low, high)`` of the suffixes that begin with each pattern, by backward search."""
        low = np.zeros(len(lengths), np.int64)
        high = np.where(lengths > 0, self.size, 0)
        live = np.flatnonzero(high)
        done = 0
        while len(live):
            symbol = patterns[live, lengths[live] - 1 - done]
            low[live], high[live] = self._step(symbol, low[live]), self._step(symbol, high[live])
            done += 1
            live = live[(low[live] < high[live]) & (lengths[live] > done)]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to a sampled position, counting steps."""
        found = np.empty(len(rows), np.int64)
        live, steps = np.arange(len(rows)), 0
        row = rows.copy()
        while len(live):
            here = self.sampled[row[live]]
            hit = self.sampled[row[live] + 1] > here
            found[live[hit]] = self.positions[here[hit]] + steps
            live = live[~hit]
            row[live] = self._step(self.wavelet.symbol_at(row[live]), row[live])
            steps += 1
        return found
