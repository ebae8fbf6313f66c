"""A compressed FM-index over integer symbols: wavelet matrix, backward search, matching statistics.

The text is a concatenation of sequences, each closed by symbol 0.  Suffixes are
ordered by their first ``DEPTH`` symbols (prefix doubling), which is all that
patterns of up to ``DEPTH`` symbols can tell apart.  What is kept is the wavelet
matrix of the transform, a byte a suffix for common prefixes with a tree of minima
above (two bytes a suffix in all), and a wavelet matrix of the sequences' label ranks
in suffix order, which gives the smallest label of an interval without listing it.
Neither text nor suffix array is kept.  Searches run in lockstep over many sequences
at once, so every step is a handful of array operations.
"""

from __future__ import annotations

import numpy as np

DEPTH = 64


class WaveletMatrix:
    """Rank queries over a symbol array: one packed bit row a level, with a count every 64 bits."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.n = len(symbols)
        self.levels = max(1, int(sigma - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        now = symbols
        for level in reversed(range(self.levels)):
            bit = (now >> level) & 1
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[: self.n] = bit
            words = np.packbits(padded.reshape(-1, 8), axis=1, bitorder="little").ravel().view(np.uint64)
            counts = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=counts[1:])
            self.words.append(words)
            self.counts.append(counts[:-1].astype(np.int32))
            self.zeros.append(int(self.n - counts[-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low, high = np.zeros_like(at), at
        for k, level in enumerate(reversed(range(self.levels))):
            one = ((symbol >> level) & 1).astype(bool)
            a, b = self._ones(k, low), self._ones(k, high)
            low = np.where(one, self.zeros[k] + a, low - a)
            high = np.where(one, self.zeros[k] + b, high - b)
        return high - low

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest symbol in each non-empty range."""
        out = np.zeros(len(low), np.int64)
        for k, level in enumerate(reversed(range(self.levels))):
            a, b = self._ones(k, low), self._ones(k, high)
            none = (high - low) == (b - a)  # no zero here: all have this bit
            out[none] |= 1 << level
            low = np.where(none, self.zeros[k] + a, low - a)
            high = np.where(none, self.zeros[k] + b, high - b)
        return out

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[k][word] + np.bitwise_count(self.words[k][word] & mask).astype(np.int64)


class Minima:
    """The nearest value below a bound to either side, by a tree of minima of aligned blocks."""

    def __init__(self, values: np.ndarray) -> None:
        self.n = len(values)
        size = 1 << max(0, int(self.n - 1).bit_length())
        now = np.zeros(size, np.uint8)  # beyond the end every bound is passed
        now[: self.n] = values
        self.levels = [now]
        while len(now) > 1:
            now = np.minimum(now[::2], now[1::2])
            self.levels.append(now)

    def _level(self, k: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), np.int64)
        for level in np.unique(k):
            m = k == level
            out[m] = self.levels[level][at[m]]
        return out

    def before(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The last place up to ``at`` whose value is below the bound; place 0 holds 0."""
        return self._nearest(at, bound, -1)

    def after(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The first place from ``at`` on whose value is below the bound, or the length."""
        found = np.full(len(at), self.n, np.int64)
        inside = at < self.n
        found[inside] = np.minimum(self._nearest(at[inside], bound[inside], 1), self.n)
        return found

    def _nearest(self, at: np.ndarray, bound: np.ndarray, step: int) -> np.ndarray:
        place, level, down = at.astype(np.int64).copy(), np.zeros(len(at), np.int64), np.zeros(len(at), bool)
        out = np.full(len(at), self.n if step > 0 else 0, np.int64)
        live = np.arange(len(at))
        while len(live):
            k, p = level[live], place[live]
            below = self._level(k, p) < bound[live]
            found = below & (k == 0)
            out[live[found]] = p[found]
            # into the half that is nearer
            into = live[below & (k > 0)]
            level[into] -= 1
            place[into] = 2 * place[into] + (step < 0)
            # past this block, and up where it closes a pair
            past = live[~below]
            place[past] += step
            ends = (place[past] < 0) | (place[past] >= (len(self.levels[0]) >> level[past]))
            up = past[~ends & ((place[past] & 1) == (0 if step > 0 else 1))]
            up = up[level[up] < len(self.levels) - 1]
            place[up] >>= 1
            level[up] += 1
            live = np.concatenate([into, past[~ends]])
        return out


class FMIndex:
    """Index of ``sequences`` of symbols >= 1 (any integers below 2**63), each with a label."""

    def __init__(self, sequences: list[np.ndarray], labels: np.ndarray) -> None:
        size = np.array([len(s) + 1 for s in sequences])
        raw = np.zeros(int(size.sum()), np.int64)
        self.start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        for at, sequence in zip(self.start, sequences):
            raw[at : at + len(sequence)] = sequence
        closes = self.start + size - 1
        self.alphabet, text = np.unique(raw[np.setdiff1d(np.arange(len(raw)), closes, assume_unique=True)], return_inverse=True) if len(raw) > len(closes) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        symbols = np.zeros(len(raw), np.int64)
        body = np.ones(len(raw), bool)
        body[closes] = False
        symbols[body] = text + 1
        self.n, self.sigma = len(symbols), len(self.alphabet) + 1
        rank, ranks, width = symbols, [symbols], 1
        while width < DEPTH:
            ahead = np.zeros(self.n, np.int64)
            ahead[:-width] = rank[width:] + 1 if self.n > width else 0
            rank = np.unique(rank * (self.n + 2) + ahead, return_inverse=True)[1]
            ranks.append(rank)
            width *= 2
        suffixes = np.argsort(rank, kind="stable")
        before = symbols[suffixes - 1]  # the text is read as a circle
        self.wavelet = WaveletMatrix(before, self.sigma)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=self.sigma))]).astype(np.int64)
        # Common prefix of neighbours, up to DEPTH, by the ranks of each width.
        common = np.zeros(self.n + 1, np.uint8)
        a, b = suffixes[:-1].copy(), suffixes[1:].copy()
        length = np.zeros(max(0, self.n - 1), np.int64)
        for k in reversed(range(len(ranks))):
            ok = (a < self.n) & (b < self.n)
            ok[ok] = ranks[k][a[ok]] == ranks[k][b[ok]]
            step = np.where(ok, 1 << k, 0)
            fits = length + step <= DEPTH
            step = np.where(fits, step, 0)
            length, a, b = length + step, a + step, b + step
        common[1 : self.n] = length
        self.common = Minima(common)
        self.labels, ranked = np.unique(np.asarray(labels, np.int64), return_inverse=True)
        owner = np.searchsorted(self.start, suffixes, side="right") - 1
        self.owners = WaveletMatrix(ranked[owner] if self.n else np.zeros(0, np.int64), max(2, len(self.labels)))

    def symbol_ids(self, sequence: np.ndarray) -> np.ndarray:
        """Dense ids of symbols; -1 for those the index does not hold."""
        if not len(self.alphabet):
            return np.full(len(sequence), -1)
        at = np.minimum(np.searchsorted(self.alphabet, sequence), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == sequence, at + 1, -1)

    def least_label(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest label in each non-empty suffix interval."""
        return self.labels[self.owners.least(low, high)]

    def _widen(self, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the first ``length`` symbols of what the given intervals share."""
        return self.common.before(low, length), self.common.after(high, length)

    def matching_statistics(self, sequences: list[np.ndarray], cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(length, low, high, first): for each place of each sequence, the longest match that starts there, up to ``cap``, and its interval.

        Flat over all sequences; first is where each sequence starts in the flat arrays.
        """
        sizes = np.array([len(s) for s in sequences])
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        flat = self.symbol_ids(np.concatenate(sequences)) if len(sequences) else np.zeros(0, np.int64)
        out = np.zeros((3, len(flat)), np.int64)
        low, high, length = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.n), np.zeros(len(sizes), np.int64)
        for back in range(int(sizes.max(initial=0))):
            live = np.flatnonzero(sizes > back)
            place = first[live] + sizes[live] - 1 - back
            symbol = flat[place]
            a, b, m = low[live], high[live], length[live]
            full = m >= cap
            if full.any():
                m[full] = cap - 1
                a[full], b[full] = self._widen(a[full], b[full], m[full])
            todo = symbol >= 0
            gone = ~todo
            x, y, z = np.zeros_like(a), np.full_like(b, self.n), np.zeros_like(m)
            while todo.any():
                t = np.flatnonzero(todo)
                s = symbol[t]
                lo, hi = self.less[s] + self.wavelet.rank(s, a[t]), self.less[s] + self.wavelet.rank(s, b[t])
                hit = lo < hi
                x[t[hit]], y[t[hit]], z[t[hit]] = lo[hit], hi[hit], m[t[hit]] + 1
                todo[t[hit]] = False
                miss = t[~hit]
                empty = miss[m[miss] == 0]
                todo[empty] = False
                miss = miss[m[miss] > 0]
                if len(miss):  # to the parent: drop symbols at the end until the interval grows
                    edge = lambda i: self.common.levels[0][i].astype(np.int64)
                    shorter = np.minimum(np.maximum(edge(a[miss]), np.where(b[miss] < self.n, edge(np.minimum(b[miss], self.n - 1)), 0)), m[miss] - 1)
                    a[miss], b[miss] = self._widen(a[miss], b[miss], shorter)
                    m[miss] = shorter
            x[gone], y[gone], z[gone] = 0, self.n, 0
            low[live], high[live], length[live] = x, y, z
            out[:, place] = z, x, y
        return out[0], out[1], out[2], first
