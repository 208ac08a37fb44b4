"""A succinct FM-index over word sequences, in numpy: matching statistics of many sequences at once."""

from __future__ import annotations

import numpy as np


class Bits:
    """Packed bits with counts per 64."""

    def __init__(self, bit: np.ndarray):
        self.words = np.packbits(np.concatenate([bit, np.zeros(64 + -len(bit) % 64, bool)]), bitorder="little").view(np.uint64)
        self.counts = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words[:-1]), dtype=np.int64)]).astype(np.uint32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many bits are set before each position."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[word] + np.bitwise_count(self.words[word] & below).astype(np.int64)


class Wavelet:
    """A wavelet matrix: log2(symbols) levels of packed bits."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.n, self.depth = len(values), max(1, int(symbols - 1).bit_length())
        self.levels, self.zeros = [], []
        v = values
        for level in range(self.depth - 1, -1, -1):
            bit = ((v >> level) & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            v = np.concatenate([v[~bit], v[bit]])
        self.base = self._descend(np.arange(symbols), np.zeros(symbols, np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.depth):
            ones = self.levels[k].rank(at)
            at = np.where((symbols >> (self.depth - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self._descend(symbols, at) - self.base[symbols]


class FMIndex:
    """Of a text of symbols >= 1 in which 0 separates sequences; suffixes are in order of 16 symbols, which is
    all that patterns of up to 16 symbols need. ``owner`` has a number for each text position.

    Beside the wavelet matrix it keeps, per suffix, one bit where the first ``window`` symbols differ from those of the
    suffix before and one for the first window - 1; per distinct run of these, the least owner (8 bytes) and the first
    suffix (4 bytes).
    """

    ORDER = 16

    def __init__(self, text: np.ndarray, owner: np.ndarray, window: int):
        if not 2 <= window <= self.ORDER:
            raise ValueError(f"window must be 2 to {self.ORDER}")
        self.window, n = window, len(text)
        ranks = {1: np.concatenate([text.astype(np.int64), np.zeros(self.ORDER, np.int64)])}
        size = 1
        while size < self.ORDER:  # ranks by the first 2, 4, ... symbols
            r = ranks[size]
            _, inverse = np.unique(r[:n] * (int(r.max()) + 1) + r[size : n + size], return_inverse=True)
            size *= 2
            ranks[size] = np.concatenate([inverse + 1, np.zeros(self.ORDER, np.int64)])
        order = np.argsort(ranks[self.ORDER][:n], kind="stable")
        self.symbols = int(text.max()) + 1 if n else 1
        self.bwt = Wavelet(np.where(order > 0, text[order - 1], 0), self.symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.symbols))])

        def edges(length: int) -> np.ndarray:
            """Where suffixes begin whose first ``length`` symbols differ from those before."""
            new, done = np.zeros(n, bool), 0
            for s in (16, 8, 4, 2, 1):
                if length - done >= s:
                    r = ranks[s][order + done]
                    new[1:] |= r[1:] != r[:-1]
                    done += s
            new[:1] = True
            return new

        shorter, whole = edges(window - 1), edges(window)
        self.shorter, self.whole = Bits(shorter), Bits(whole)
        self.starts = np.append(np.flatnonzero(shorter), n).astype(np.uint32)
        self.least = np.minimum.reduceat(owner[order], np.flatnonzero(whole)) if n else owner

    def step(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the ranges of the patterns with one more symbol on their left."""
        c = self.first[symbols]
        return c + self.bwt.rank(symbols, low), c + self.bwt.rank(symbols, high)

    def find(self, text: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of the patterns of known symbols that begin at ``at``, each of its own length."""
        low, high = np.zeros(len(at), np.int64), np.full(len(at), self.bwt.n, np.int64)
        for i in range(int(length.max(initial=0))):
            some = np.flatnonzero(length > i)
            low[some], high[some] = self.step(text[at[some] + length[some] - 1 - i], low[some], high[some])
        return low, high

    def longest(self, text: np.ndarray, at: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The longest matches that begin at ``at``, up to ``most`` symbols: lengths and ranges. As a part of what
        occurs occurs, a binary search over the lengths finds them."""
        length = np.zeros_like(most)
        low, high = np.zeros(len(at), np.int64), np.full(len(at), self.bwt.n, np.int64)
        most = most.copy()
        while len(some := np.flatnonzero(length < most)):
            half = (length[some] + most[some] + 1) // 2
            lo, hi = self.find(text, at[some], half)
            found = hi > lo
            yes, no = some[found], some[~found]
            length[yes], low[yes], high[yes] = half[found], lo[found], hi[found]
            most[no] = half[~found] - 1
        return length, low, high

    def matching(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of sequences (starts, sizes in text), which need not be in the index; symbols that it hasn't
        are 0 or beyond its own. For every position: the length of the longest match that begins there, up to
        ``window``, and, where it has that length, the least owner among all places where it stands (else the largest
        integer).

        All sequences go on together from their right ends. A match of the window's length is cut to one symbol less
        (the enclosing range) before the next symbol is put on its left; where that ends the match, the longest shorter
        one takes its place.
        """
        least = np.full(len(text), np.iinfo(np.int64).max, np.int64)
        lengths = np.zeros(len(text), np.int8)
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        low, high, length = np.zeros(len(starts), np.int64), np.full(len(starts), self.bwt.n, np.int64), np.zeros(len(starts), np.int64)
        alive = np.searchsorted(-sizes, -np.arange(1, int(sizes.max(initial=0)) + 1), side="right")
        for t, n in enumerate(alive):
            at = starts[:n] + sizes[:n] - 1 - t
            lo, hi, m, symbol = low[:n], high[:n], length[:n], text[at]
            full = m == self.window
            if full.any():
                run = self.shorter.rank(lo + 1) - 1
                lo, hi, m = np.where(full, self.starts[run], lo).astype(np.int64), np.where(full, self.starts[run + 1], hi).astype(np.int64), np.where(full, m - 1, m)
            known = (symbol > 0) & (symbol < self.symbols)
            lo, hi = self.step(np.where(known, symbol, 0), lo, hi)
            m = m + 1
            if len(bad := np.flatnonzero(~known | (hi <= lo))):
                m[bad], lo[bad], hi[bad] = self.longest(text, at[bad], np.where(known[bad], m[bad] - 1, 0))
            low[:n], high[:n], length[:n], lengths[at] = lo, hi, m, m
            whole = m == self.window
            least[at[whole]] = self.least[self.whole.rank(lo[whole] + 1) - 1]
        return lengths, least
