"""Substring dedup by a compressed FM-index for each shard of word stretches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .repeats import remove_repeats, runs


class WaveletMatrix:
    """Rank over a sequence of symbols: one bit vector a level, high bit first, packed to 64-bit words with a count before each."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.n, self.levels, self.zeros = len(symbols), [], []
        self.bits = max(1, int(sigma - 1).bit_length())
        s = symbols.astype(np.uint32)
        for level in reversed(range(self.bits)):
            bit = (s >> np.uint32(level)) & np.uint32(1)
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            self.levels.append((words, np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.int64)).astype(np.int32)))
            self.zeros.append(self.n - int(bit.sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def places(self, symbol: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """Occurrences of each symbol before each place, plus the symbol's own first place in the last level."""
        places = [p.copy() for p in places]
        for k, ((words, before), zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbol >> (self.bits - 1 - k)) & 1 == 1
            for i, p in enumerate(places):
                word = p >> 6
                ones = before[word] + np.bitwise_count(words[word] & ((np.uint64(1) << (p & 63).astype(np.uint64)) - np.uint64(1)))
                places[i] = np.where(one, zeros + ones, p - ones)
        return places


class RunLengthRank:
    """Occurrences of a symbol before a place in a sequence that is kept as its runs: a wavelet matrix of their symbols, and their places."""

    def __init__(self, sequence: np.ndarray, sigma: int):
        new = np.ones(len(sequence), bool)
        new[1:] = sequence[1:] != sequence[:-1]
        self.starts = np.flatnonzero(new)
        self.heads = sequence[self.starts].astype(np.int32)
        self.matrix = WaveletMatrix(self.heads, sigma)
        size = np.diff(np.append(self.starts, len(sequence)))
        order = np.argsort(self.heads, kind="stable")
        self.before = np.append(0, np.cumsum(size[order]))  # units in the runs before, by symbol and then place
        self.runs_below = np.append(0, np.cumsum(np.bincount(self.heads, minlength=sigma)))
        every = np.arange(sigma)
        self.matrix_base = self.matrix.places(every, np.zeros(sigma, np.int64))[0]

    def ranks(self, symbol: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        run = [np.searchsorted(self.starts, p, "right") - 1 for p in places]
        base, first = self.matrix_base[symbol], self.runs_below[symbol]
        out = []
        for p, r, k in zip(places, run, self.matrix.places(symbol, *run), strict=True):
            inside = np.where(self.heads[r] == symbol, p - self.starts[r], 0)
            out.append(self.before[first + k - base] - self.before[first] + inside)
        return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling."""
    rank = text.astype(np.int64)
    k, n = 1, len(text)
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - k] = rank[k:]
        order = np.lexsort((after, rank))
        new = np.ones(n, bool)
        new[1:] = (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        k *= 2
        if new.all() or k >= n:
            return order


class FMIndex:
    """Burrows-Wheeler transform of the shard's entries, each ended by an end mark of its own, run-length compressed.

    Besides its rank structure: the smallest owner of each range of suffixes (a sparse table), and common prefixes of neighbours
    up to `length` units, by which a match is shortened to the next length that more suffixes share.
    """

    def __init__(self, symbols: np.ndarray, size: np.ndarray, ids: np.ndarray, sigma: int, length: int):
        entries = len(size)
        ends = np.cumsum(size + 1) - 1
        text = np.empty(len(symbols) + entries, np.int64)
        mark = np.zeros(len(text), bool)
        mark[ends] = True
        text[mark], text[~mark] = np.arange(entries), symbols + entries
        order = suffix_order(text)
        self.n = len(text)
        before = text[order - 1]
        self.rank = RunLengthRank(np.where(before < entries, 0, before - entries + 1), sigma + 1)
        self.below = entries + np.append(0, np.cumsum(np.bincount(symbols, minlength=sigma)))
        owner = np.repeat(np.arange(entries), size + 1)[order]
        self.least = [ids[owner]]
        while 1 << len(self.least) <= self.n:
            t, step = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(t[:-step], t[step:]))
        common, alike = np.zeros(self.n + 1, np.int32), np.arange(1, self.n)
        for k in range(length):  # end marks differ, so no common prefix runs over one
            alike = alike[text[order[alike] + k] == text[order[alike - 1] + k]]
            common[alike] = k + 1
        self.common = common
        place = np.arange(self.n)
        self.begin, self.end = np.empty((length + 1, self.n), np.int32), np.empty((length + 1, self.n), np.int32)
        for k in range(length + 1):
            self.begin[k] = np.maximum.accumulate(np.where(common[:-1] < k, place, 0))
            self.end[k] = np.minimum.accumulate(np.where(common[1:] < k, place + 1, self.n)[::-1])[::-1]

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: the suffixes that begin with symbol and go on as those from lo to hi."""
        lo, hi = self.rank.ranks(symbol + 1, lo, hi)
        return lo + self.below[symbol], hi + self.below[symbol]

    def least_in(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Smallest id of the entries in each range."""
        out = np.empty(len(lo), np.int64)
        span = np.frexp((hi - lo).astype(np.float64))[1] - 1
        for level in np.unique(span):
            at = np.flatnonzero(span == level)
            out[at] = np.minimum(self.least[level][lo[at]], self.least[level][hi[at] - (1 << int(level))])
        return out


def matching_statistics(index: FMIndex, symbols: np.ndarray, size: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """For each unit of the streamed documents: how long a stretch from there, up to `length`, lies in an entry of a smaller id.

    Documents are read backward, all in step. A match that can't be extended by the next unit is shortened from its end to the
    longest prefix that more suffixes share, as often as needed.
    """
    out = np.zeros(len(symbols), np.int32)
    after = np.cumsum(size)
    lo, hi, matched = np.zeros(len(size), np.int64), np.full(len(size), index.n, np.int64), np.zeros(len(size), np.int64)
    for step in range(1, int(size.max(initial=0)) + 1):
        live = np.flatnonzero(size >= step)
        asking = live
        while len(asking):
            a, z = index.extend(symbols[after[asking] - step], lo[asking], hi[asking])
            ok = z > a
            ok[ok] = index.least_in(a[ok], z[ok]) < ids[asking[ok]]
            yes, a, z = asking[ok], a[ok], z[ok]
            over = matched[yes] == length
            lo[yes], hi[yes] = np.where(over, index.begin[length][a], a), np.where(over, index.end[length][a], z)
            matched[yes] = np.minimum(matched[yes] + 1, length)
            asking = asking[~ok]
            asking = asking[matched[asking] > 0]
            shorter = np.maximum(index.common[lo[asking]], index.common[hi[asking]])
            at = lo[asking]
            lo[asking], hi[asking], matched[asking] = index.begin[shorter, at], index.end[shorter, at], shorter
        out[after[live] - step] = matched[live]
    return out


def held_before(symbols: np.ndarray, size: np.ndarray, ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches (entry, from, to) of `length` words or more that entries with a smaller id hold too.

    Every entry is streamed against the index of its shard; where its matching statistics reach `length`, the interval is reported.
    """
    index = FMIndex(symbols, size, ids, int(symbols.max(initial=0)) + 1, length)
    at = np.flatnonzero(matching_statistics(index, symbols, size, ids, length) >= length)
    entry = np.searchsorted(np.cumsum(size), at, "right")
    start = at - (np.cumsum(size) - size)[entry]
    return runs(entry, start, start + length)


def substring_dedup(docs: DataFrame, *, length: int = 13, gram: int = 7, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 2 << 20) -> DataFrame:
    """Words of each text without those covered by a window of `length` words that a smaller document holds too.

    Returns every row with n_units (words), n_removed, spans (in words) and kept (the words left, joined by one space).
    Null and empty texts, repeated ids, null ids and clashing columns: see remove_repeats.
    """
    return remove_repeats(docs, held_before, unit="word", length=length, gram=gram, id_col=id_col, text_col=text_col, batch_bytes=batch_bytes)
