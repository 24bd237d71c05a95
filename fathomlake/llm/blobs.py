"""Integer arrays as compact binary cells, for exchanges that move few large rows instead of many small ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64's)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def pack(*columns: np.ndarray) -> bytes:
    """Columns of non-negative integers: for each its count, its bytes an item, then its byte planes, lowest first."""
    parts = []
    for a in columns:
        if a.dtype in (np.uint8, np.bool_):
            parts.append(len(a).to_bytes(8, "little") + b"\x01" + np.ascontiguousarray(a).tobytes())
            continue
        a = np.ascontiguousarray(a, dtype="<u8")
        width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
        parts.append(len(a).to_bytes(8, "little") + bytes([width]))
        parts.append(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    return b"".join(parts)


def unpack(blob: bytes) -> list[np.ndarray]:
    """The columns: of uint8 where an item takes one byte, else of uint64."""
    out, at, raw = [], 0, np.frombuffer(blob, np.uint8)
    while at < len(blob):
        n, width = int.from_bytes(blob[at : at + 8], "little"), blob[at + 8]
        at += 9
        if width == 1:
            out.append(raw[at : at + n])
            at += n
            continue
        a = np.zeros((n, 8), np.uint8)
        a[:, :width] = raw[at : at + n * width].reshape(width, n).T
        out.append(a.reshape(-1).view("<u8"))
        at += n * width
    return out


def split_by(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by bucket (stable), the buckets that occur, and where each begins and ends in that order."""
    order = np.argsort(bucket, kind="stable")
    values, starts = np.unique(bucket[order], return_index=True)
    return order, values, np.append(starts, len(bucket))


def text_buffer(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column laid end to end, and each row's offsets (null: empty)."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], a.type)
    if a.null_count:
        a = a.fill_null("")
    a = a.cast(pa.large_string())
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if len(a) and a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each word `[^\\x20\\x09-\\x0D]+`, and each row's first word (one more entry for the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~is_space(data)
    first = word.copy()
    first[1:] &= ~word[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    first[cuts] = word[cuts]
    last = word.copy()
    last[:-1] &= ~word[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = word[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


_B, _BINV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(kind: str, base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i < n."""
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        have = np.ones(1, U64)
        while len(have) < n:
            have = np.concatenate([have, have * U64(pow(base, len(have), 1 << 64))])
        if n <= 1 << 22:
            _POWERS[kind] = have
    return have[:n]


class RollingHash:
    """Hash of any stretch of a token array in constant time: prefix sums of token * base ** position modulo 2 ** 64."""

    def __init__(self, tokens: np.ndarray):
        self.n = len(tokens)
        self.sums = np.zeros(self.n + 1, U64)
        np.cumsum(tokens * _powers("up", _B, self.n + 1)[: self.n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * _powers("down", _BINV, self.n + 1)[start]

    def grams(self, q: int) -> np.ndarray:
        k = max(0, self.n - q + 1)
        return (self.sums[q : q + k] - self.sums[:k]) * _powers("down", _BINV, self.n + 1)[:k]


def byte_tokens(data: np.ndarray) -> np.ndarray:
    return _TABLE[data]


#: Bytes that are hashed at once: what bounds the memory of word_hashes.
STEP = 1 << 21


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    out = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + STEP, "right")))
        h = RollingHash(_TABLE[data[base : ends[to - 1]]])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mix(h.of(s, e) + (e - s).astype(U64) * U64(0xA0761D6478BD642F))
        at = to
    return out


def sliding(op: np.ufunc, a: np.ndarray, w: int) -> np.ndarray:
    """op over each w consecutive items, by doubling."""
    if len(a) < w:
        return a[:0]
    out, k = a, 1
    while 2 * k <= w:
        out, k = op(out[:-k], out[k:]), 2 * k
    return op(out[: len(a) - w + 1], out[w - k : w - k + len(a) - w + 1]) if k < w else out
