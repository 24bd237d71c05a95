"""Suffix-array dedup: bucket-pointer refinement over the stretches that may repeat."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .repeats import remove_repeats, runs

#: Bytes of the initial buckets' grams.
Q = 8
#: Suffixes whose buckets are refined together.
TOGETHER = 1 << 14
#: Bytes of a batch of a large input.
MOST_BYTES = 16 << 20


def grams(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The Q bytes from each place on as one number, zeros past the end of its entry. left: bytes from there to the end."""
    out = np.zeros(len(text), np.uint64)
    for k in range(Q):
        n = len(text) - k
        out[:n] |= np.where(left[:n] > k, text[k:], 0).astype(np.uint64) << np.uint64(8 * (Q - 1 - k))
    return out


def refine(order: np.ndarray, pointer: np.ndarray, left: np.ndarray, length: int) -> None:
    """Bucket-pointer refinement of the suffix order to a depth of `length` bytes, in place.

    order: places sorted by their first Q bytes; pointer: of each place the start of its bucket in the order. Buckets are taken
    from the first to the last, small ones together. A bucket's suffixes are sorted by the bucket pointers of the places `offset`
    further on; its parts get their own pointers at once, and are refined in their turn at offset + Q. So later sorts, of the
    same bucket's parts and of later buckets, find the finer pointers that earlier ones wrote.
    """
    n = len(order)
    opens = np.append(np.flatnonzero(pointer[order] == np.arange(n)), n)
    i = 0
    while i < len(opens) - 1:
        j = max(i + 1, int(np.searchsorted(opens, opens[i] + TOGETHER, "right")) - 1)
        slots = np.arange(opens[i], opens[j], dtype=np.int32)
        i = j
        offset = Q
        while True:
            near = pointer[order[slots]]
            alone = np.ones(len(slots), bool)
            same = near[1:] == near[:-1]
            alone[1:] &= ~same
            alone[:-1] &= ~same
            slots, near = slots[~alone], near[~alone]
            if not len(slots) or offset >= length:
                break
            at = order[slots]
            far = np.where(left[at] > offset, pointer[np.minimum(at + offset, n - 1)], -1)
            both = (near.astype(np.int64) << 32) + far
            by = np.argsort(both)
            at, both = at[by], both[by]
            new = np.ones(len(at), bool)
            new[1:] = both[1:] != both[:-1]
            order[slots] = at
            pointer[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
            offset += Q


def suffix_array(text: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places by the `length` bytes from there on (places that agree in all of them in any order), their bytes left, and grams."""
    left = (np.repeat(np.cumsum(size), size) - np.arange(len(text))).astype(np.int32)
    gram = grams(text, left)
    order = np.argsort(gram, kind="stable").astype(np.int32)
    values = gram[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    pointer = np.empty(len(text), np.int32)
    pointer[order] = np.maximum.accumulate(np.where(new, np.arange(len(values)), 0))
    refine(order, pointer, left, length)
    return order, left, gram


def held_before(text: np.ndarray, size: np.ndarray, ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches (entry, from, to) of `length` bytes or more that entries with a smaller id hold too, by the suffix array.

    Neighbours in the order whose first `length` bytes are equal hold the same window; the bytes themselves are compared.
    """
    order, left, gram = suffix_array(text, size, length)
    at = order[left[order] >= length]
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    new = np.ones(len(at), bool)
    if length >= Q:
        new[1:] = False
        for k in [*range(0, length - Q, Q), length - Q]:
            new[1:] |= gram[at[1:] + k] != gram[at[:-1] + k]
    else:
        new[1:] = (gram[at[1:]] ^ gram[at[:-1]]) >> np.uint64(8 * (Q - length)) != 0
    entry = np.searchsorted(np.cumsum(size), at, "right")
    least = np.minimum.reduceat(ids[entry], np.flatnonzero(new))[np.cumsum(new) - 1]
    held = ids[entry] > least
    entry = entry[held]
    start = at[held] - (np.cumsum(size) - size)[entry]
    return runs(entry, start, start + length)


def suffix_array_dedup(docs: DataFrame, *, length: int = 50, gram: int = 16, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 2 << 20) -> DataFrame:
    """Bytes of each text without those covered by a `length`-byte string that a smaller document holds too.

    Returns every row with n_units, n_removed, spans and kept (binary: a cut may fall inside a character). Null and
    empty texts, repeated ids, null ids and clashing columns: see remove_repeats. Batches grow from batch_bytes to MOST_BYTES
    with the input.
    """
    return remove_repeats(docs, held_before, unit="byte", length=length, gram=gram, id_col=id_col, text_col=text_col, batch_bytes=batch_bytes, most_bytes=max(batch_bytes, MOST_BYTES))
