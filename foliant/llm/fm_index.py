"""A compressed FM-index over sequences of 64-bit words: a wavelet matrix of bit vectors over the Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np

_U = np.uint64


class BitVector:
    """64 bits a machine word, with the ones before each word."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
        padded[: self.n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.zeros(len(ones), np.int32)
        np.cumsum(ones[:-1], out=self.before[1:])
        self.zeros = self.n - int(self.before[-1]) - int(ones[-1])

    def rank1(self, i: np.ndarray) -> np.ndarray:
        at = i >> 6
        low = (_U(1) << (i & 63).astype(np.uint64)) - _U(1)
        return self.before[at] + np.bitwise_count(self.words[at] & low)


class WaveletMatrix:
    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = []
        for level in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bit = (seq >> level) & 1
            self.levels.append((level, BitVector(bit)))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))
        symbols = np.arange(sigma)
        self.start = np.zeros(sigma, np.int64)
        self.start = self._down(symbols, np.zeros(sigma, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bits in self.levels:
            ones = bits.rank1(i)
            i = np.where((c >> level) & 1, bits.zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol c stands before place i."""
        return self._down(c, i) - self.start[c]


def suffix_order(seq: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes by their first `depth` symbols or more (prefix doubling)."""
    rank, k = seq.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while k < depth:
        nxt = np.zeros_like(rank)
        nxt[:-k] = rank[k:] + 1
        key = rank * (int(nxt.max()) + 1) + nxt
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
        if rank[order[-1]] == len(rank) - 1:
            break
        k *= 2
    return order


class FMIndex:
    """Over the segments words[bounds[i]:bounds[i+1]], each counted weight[i] times. Patterns may be as long as the longest segment."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray, weight: np.ndarray):
        size = np.diff(bounds)
        _, symbol = np.unique(words, return_inverse=True)
        n = len(words) + len(size)
        owner = np.repeat(np.arange(len(size)), size)
        self.seq = np.zeros(n, np.int64)  # 0 closes a segment
        self.seq[np.arange(len(words)) + owner] = symbol + 1
        self.begin = bounds[:-1] + np.arange(len(size))
        self.size = size
        sigma = int(symbol.max(initial=-1)) + 2
        order = suffix_order(self.seq, int(size.max(initial=1)))
        self.bwt = WaveletMatrix(self.seq[order - 1], sigma)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(self.seq, minlength=sigma))))
        each = np.zeros(n, np.int64)
        each[np.arange(len(words)) + owner] = np.repeat(weight, size)
        self.mass = np.concatenate(([0], np.cumsum(each[order])))

    def search(self, end: np.ndarray, length: np.ndarray, least: int) -> np.ndarray:
        """Backward search for the patterns of `length` symbols that end before place `end` of the text itself.

        The number of symbols matched from the right while the occurrences, by weight, are `least` or more.
        """
        matched = np.zeros(len(end), np.int64)
        live = np.arange(len(end))
        lo, hi = np.zeros(len(end), np.int64), np.full(len(end), len(self.seq), np.int64)
        while len(live):
            c = self.seq[end[live] - 1 - matched[live]]
            both = self.bwt.rank(np.concatenate((c, c)), np.concatenate((lo, hi)))
            lo, hi = self.first[c] + both[: len(c)], self.first[c] + both[len(c) :]
            good = self.mass[hi] - self.mass[lo] >= least
            live, lo, hi = live[good], lo[good], hi[good]
            matched[live] += 1
            on = matched[live] < length[live]
            live, lo, hi = live[on], lo[on], hi[on]
        return matched

    def matching_statistics(self, window: int, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, end, length), by segment and end: how many symbols before each end occur `least` times or more, as far as it matters.

        A whole segment that repeats is one row. Elsewhere lengths are cut off at `window`, the threshold, and the ends that
        a shorter match has shown to lie below it are left out.
        """
        starts = self.size - window + 1
        fits = np.flatnonzero(starts > 0)
        whole = self.search((self.begin + self.size)[fits], self.size[fits], least)
        full = whole == self.size[fits]
        seg, end, length = [fits[full]], [self.size[fits[full]]], [whole[full]]
        open_ = fits[~full]
        at = np.zeros(len(open_), np.int64)
        while len(open_):
            m = self.search(self.begin[open_] + at + window, np.full(len(open_), window), least)
            seg.append(open_)
            end.append(at + window)
            length.append(m)
            # the symbol before a match ends every longer one: the next window begins behind it
            at = at + np.where(m == window, 1, window - m)
            go = at < starts[open_]
            open_, at = open_[go], at[go]
        seg, end, length = np.concatenate(seg), np.concatenate(end), np.concatenate(length)
        by = np.lexsort((end, seg))
        return seg[by], end[by], length[by]

    def repeated(self, window: int, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, from, to) of the longest stretches whose matching statistics reach `window`; stretches that touch are one."""
        seg, end, length = self.matching_statistics(window, least)
        long = length >= window
        seg, a, b = seg[long], (end - length)[long], end[long]
        apart = np.ones(len(seg), bool)
        apart[1:] = (seg[1:] != seg[:-1]) | (a[1:] > b[:-1])
        head = np.flatnonzero(apart)
        tail = np.append(head[1:], len(seg))[: len(head)] - 1
        return seg[head], a[head], b[tail]
