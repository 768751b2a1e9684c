"""FM-index over whole numbers: backward search with wavelet ranks, sampled positions."""

from __future__ import annotations

import numpy as np


class Wavelet:
    """Ranks and symbols of a sequence, one bit vector for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.zeros, self.ones = bits, [], []
        now = symbols
        for bit in range(bits - 1, -1, -1):
            up = (now >> bit) & 1 == 1
            ones = np.zeros(len(now) + 1, np.int32)
            np.cumsum(up, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(now) - int(ones[-1]))
            now = np.concatenate([now[~up], now[up]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low, high = np.zeros_like(at), at
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[level], self.zeros[level]
            up = (symbol >> bit) & 1 == 1
            low1, high1 = ones[low], ones[high]
            low = np.where(up, zeros + low1, low - low1)
            high = np.where(up, zeros + high1, high - high1)
        return high - low

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[level], self.zeros[level]
            up = ones[at + 1] > ones[at]
            out |= up.astype(out.dtype) << bit
            at = np.where(up, zeros + ones[at], at - ones[at])
        return out


class FMIndex:
    """Index of a text of symbols 1 .. sigma, cut into runs by 0; it starts with a 0.

    A run's separator sorts by its place, so suffixes differ within the longest run and
    sorting by doubled prefixes ends after log2 of that length.
    """

    def __init__(self, text: np.ndarray, sigma: int, sample: int = 8):
        n = len(text)
        cut = text == 0
        order = np.cumsum(cut)
        rank = np.where(cut, order - 1, text.astype(np.int64) + int(order[-1]) if n else text)
        sa, width = np.argsort(rank, kind="stable"), 1
        rank = self._dense(rank[sa], sa)
        while n and rank.max() < n - 1:
            follow = np.zeros(n, np.int64)
            follow[: max(0, n - width)] = rank[width:] + 1
            key = rank * (n + 1) + follow
            sa = np.argsort(key, kind="stable")
            rank = self._dense(key[sa], sa)
            width *= 2
        before = text[sa - 1] if n else text
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))]).astype(np.int64)
        self.wavelet = Wavelet(before.astype(np.int64), max(1, int(sigma).bit_length()))
        # Positions are kept at every sample-th place of a run, its first one included, so a
        # walk to the left never crosses a separator.
        run_start = np.maximum.accumulate(np.where(cut, np.arange(n), 0)) if n else np.zeros(0, np.int64)
        kept = ((sa - run_start[sa] - 1) % sample == 0) | cut[sa]
        self.rank_of_kept = np.concatenate([[0], np.cumsum(kept)])
        self.kept, self.places = kept, sa[kept]

    @staticmethod
    def _dense(keys: np.ndarray, sa: np.ndarray) -> np.ndarray:
        rank = np.empty(len(sa), np.int64)
        rank[sa] = np.concatenate([[0], np.cumsum(keys[1:] != keys[:-1])])[: len(sa)]
        return rank

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that start with each phrase (rows, filled up with 0 at the end)."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.counts[-1], np.int64)
        for step in range(phrases.shape[1]):
            live = np.flatnonzero((lengths > step) & (high > low))
            if not len(live):
                break
            c = phrases[live, lengths[live] - 1 - step]
            low[live] = self.counts[c] + self.wavelet.rank(c, low[live])
            high[live] = self.counts[c] + self.wavelet.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of the suffixes of these ranks."""
        out = np.zeros(len(rows), np.int64)
        at, todo, steps = rows.copy(), np.arange(len(rows)), 0
        while len(todo):
            here = self.kept[at]
            out[todo[here]] = self.places[self.rank_of_kept[at[here]]] + steps
            at, todo = at[~here], todo[~here]
            c = self.wavelet.symbol(at)
            at = self.counts[c] + self.wavelet.rank(c, at)
            steps += 1
        return out
