"""Removal of token windows that a document with a smaller id also holds: the distributed part of substring dedup.

A unit is a byte or a word; a window is `length` consecutive units of one document. Every window has an anchor, the
least-hashed run of `gram` units in it, so equal windows have equal anchors, and about 2 / (length - gram + 2) of all
positions are anchors. An anchor's context is the stretch of the consecutive windows that it stands for. Four rounds of
packed arrays follow between batches of documents and buckets of anchors:

1. Batches count their anchors; buckets tell which anchors occur again, and which are hot (in over HOT contexts).
2. Batches list the contexts of anchors that occur again, each once, whatever many of their documents hold it. Around a hot
   anchor each window is a context by itself, listed under its own hash, so that no bucket grows with a hot anchor.
   Buckets ask the first document that holds a context for its content, where the context or its anchor has other holders.
3. Buckets index the contents in shards of bounded size (a suffix array or an FM-index, chosen by the caller). The index
   alone tells which stretches of a context lie in a smaller document; a document of larger id that holds the very same
   context (equal in 104 bits of hash) has that content before it as a whole.
4. Batches cut the stretches that the index named out of their documents.

Memory follows the batch, the bucket's lists and the shard, none of which grows with a hot key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blobs
from .blobs import U64, mix, pack, unpack

#: Window starts that are hashed at once.
CHUNK = 1 << 16
#: Contexts (summed over batches) from which on an anchor's windows are listed one by one.
HOT = 1024
#: Units in an index.
SHARD = 1 << 17
#: Batches to a bucket: a round has up to batches x buckets messages, each of one item at least.
BATCHES_PER_BUCKET = 3
#: Batches of an input from which on they grow with it, where the caller lets them.
GROW = 128
#: Bits of an anchor's hash that are not sent.
SHIFT = U64(24)
#: Kinds of messages.
COUNTS, BITS, LISTED, ASKED, CONTENT, WHOLE, PARTS, HOT_KEYS = range(8)

#: Units (symbols below the count of different ones, or bytes), units in each entry, the entries' ids, units in a window.
#: Returns the stretches (entry, from, to) that entries with a smaller id hold too.
Index = Callable[[np.ndarray, np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray, np.ndarray]]


def dealt(spark: SparkSession, size: int, batch_bytes: int, most_bytes: int = 0) -> tuple[int, int]:
    """Batches of about batch_bytes and buckets for an input of a size, of each at least one to a shuffle partition.

    From GROW batches on they grow up to most_bytes, and there are more only beyond that: the messages of a round grow with
    the square of their number. A bucket gets as many bytes as BATCHES_PER_BUCKET batches of batch_bytes, or as one larger batch.
    """
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grown = max(batch_bytes, min(most_bytes, size // GROW))
    batches = max(partitions, -(-size // grown))
    return batches, max(partitions, batches // max(1, BATCHES_PER_BUCKET * batch_bytes // grown))


@dataclass(frozen=True)
class Plan:
    unit: str  # "byte" or "word"
    length: int  # units in a window
    gram: int  # units in an anchor
    buckets: int
    index: Index


class Batch:
    """Documents of a batch in a fixed order, as units."""

    def __init__(self, table: pa.Table, id_col: str, text_col: str, unit: str):
        order = pc.sort_indices(table, sort_keys=[(id_col, "ascending"), (text_col, "ascending")])
        self.table = table.take(order)
        ids = self.table.column(id_col).combine_chunks().cast(pa.int64())
        self.null = np.asarray(pc.is_null(ids))
        self.ids = np.asarray(pc.fill_null(ids, 0)).astype(np.int64)
        self.data, self.offsets = blobs.text_buffer(self.table.column(text_col))
        self.unit = unit
        if unit == "word":
            self.starts, self.ends, self.first = blobs.words_of(self.data, self.offsets)
            self.tokens = blobs.word_hashes(self.data, self.starts, self.ends)
        else:
            self.first = self.offsets
            self.tokens = self.data


@dataclass
class Anchors:
    key: np.ndarray  # the anchor's hash, less SHIFT bits
    context: np.ndarray  # hash of the context
    doc: np.ndarray  # row in the batch
    lo: np.ndarray  # the context, as units of the batch
    hi: np.ndarray

    def where(self, mask: np.ndarray) -> Anchors:
        return Anchors(self.key[mask], self.context[mask], self.doc[mask], self.lo[mask], self.hi[mask])


def member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_values, x)
    return sorted_values[np.minimum(at, len(sorted_values) - 1)] == x


def anchors(b: Batch, p: Plan, hot: np.ndarray) -> Anchors:
    """In the order of the batch's units. hot: sorted keys whose windows are contexts by themselves."""
    n, w, found = len(b.tokens), p.length - p.gram + 1, []
    known = int(b.first[len(b.ids) - np.count_nonzero(b.null)])  # units of rows with an id; the others come last
    for a in range(0, known - p.length + 1, CHUNK):
        end = min(n, a + CHUNK + p.length - 1)
        tokens = b.tokens[a:end]
        h = blobs.RollingHash(tokens if b.unit == "word" else blobs.byte_tokens(tokens))
        grams = mix(h.grams(p.gram)) | U64(1)
        least = blobs.sliding(np.minimum, grams, w)
        bounds = b.first[np.searchsorted(b.first, a, "right") : np.searchsorted(b.first, end, "left")] - a
        across = (bounds[:, None] - np.arange(1, p.length)).ravel()  # starts of windows that run over a document's end
        least[across[(across >= 0) & (across < len(least))]] = 0
        least[max(0, known - a) :] = 0
        opens = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        size = np.diff(np.append(opens, len(least)))
        many = -(-size // w)
        lo = np.repeat(opens, many) + w * stretches(np.zeros(len(many), np.int64), many)
        hi = np.minimum(lo + w, np.repeat(opens + size, many)) - 1 + p.length
        some = least[lo] > 0
        lo, hi = lo[some], hi[some]
        if len(hot):
            is_hot = member(hot, least[lo] >> SHIFT)
            i = stretches(lo[is_hot], (hi - lo)[is_hot] - p.length + 1)
            whole = h.of(i, i + p.length)
            found.append((mix(whole + U64(0x9E6C63D0876A9A99)) >> SHIFT, mix(whole * U64(0xD1342543DE82EF95) + least[i]), np.searchsorted(b.first, i + a, "right") - 1, i + a, i + a + p.length))
            lo, hi = lo[~is_hot], hi[~is_hot]
        context = mix(h.of(lo, hi) + (hi - lo).astype(U64) * U64(0xABC98388FB8FAC03))
        found.append((least[lo] >> SHIFT, context, np.searchsorted(b.first, lo + a, "right") - 1, lo + a, hi + a))
    columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, U64)] * 2 + [np.zeros(0, np.int64)] * 3
    return Anchors(*columns)


def runs(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of the same document that overlap or touch, made one."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    shift = doc.astype(np.int64) * (int(hi.max()) + 2)
    reach = np.maximum.accumulate(hi + shift)
    new = np.ones(len(doc), bool)
    new[1:] = (lo + shift)[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return doc[at], lo[at], np.maximum.reduceat(hi, at)


BLOB = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])


def rows(columns: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*columns, strict=True), BLOB, strict=True)], schema=BLOB) if columns else BLOB.empty_table()


def messages(table: pa.Table, kind: int) -> list[tuple[int, int, bytes]]:
    """(bucket, batch, blob) of the messages of a kind, in a fixed order."""
    return sorted((a, b, x) for a, b, k, x in zip(*(table.column(c).to_pylist() for c in ("bucket", "batch", "kind", "blob")), strict=True) if k == kind)


def told(table: pa.Table, kind: int) -> list[list[np.ndarray]]:
    return [unpack(x) for _, _, x in messages(table, kind)]


def joined(parts: list[list[np.ndarray]], columns: int) -> list[np.ndarray]:
    return [np.concatenate([x[i] for x in parts]) if parts else np.zeros(0, U64) for i in range(columns)]


def counted_keys(b: Batch, x: Anchors) -> tuple[np.ndarray, np.ndarray]:
    """The batch's different keys, and of each the contexts, where one that two documents hold counts twice."""
    order = np.lexsort((x.doc, x.context, x.key))
    key, context, doc = x.key[order], x.context[order], b.ids[x.doc[order]]
    new_context = np.ones(len(key), bool)
    new_context[1:] = (key[1:] != key[:-1]) | (context[1:] != context[:-1])
    other = np.zeros(len(key), bool)
    other[1:] = ~new_context[1:] & (doc[1:] != doc[:-1])
    values, at = np.unique(key, return_index=True)
    return values, np.add.reduceat((new_context | other).astype(np.int64), at) if len(at) else np.zeros(0, np.int64)


def count_anchors(b: Batch, batch: int, p: Plan) -> pa.Table:
    key, n = counted_keys(b, anchors(b, p, np.zeros(0, U64)))
    order, values, cut = blobs.split_by((key % U64(p.buckets)).astype(np.int64))
    return rows([(int(v), batch, COUNTS, pack(key[o], np.minimum(n[o], HOT + 1).astype(U64))) for i, v in enumerate(values) for o in [order[cut[i] : cut[i + 1]]]])


def census(table: pa.Table) -> pa.Table:
    """For each batch's keys, in their order: does the anchor occur again, and is it hot?"""
    sent = messages(table, COUNTS)
    parts = [unpack(x) for _, _, x in sent]
    key, n = joined(parts, 2)
    _, inverse = np.unique(key, return_inverse=True)
    total = np.bincount(inverse, weights=n)[inverse] if len(key) else np.zeros(0)
    out, at = [], 0
    for (bucket, batch, _), x in zip(sent, parts, strict=True):
        mine = total[at : at + len(x[0])]
        at += len(mine)
        out.append((bucket, batch, BITS, pack(np.packbits(mine > 1), np.packbits(mine > HOT))))
    return rows(out)


def again(b: Batch, bits: pa.Table, p: Plan) -> tuple[Anchors, np.ndarray]:
    """The anchors that occur again, and the sorted keys of the hot ones, by the census."""
    x = anchors(b, p, np.zeros(0, U64))
    key, _ = counted_keys(b, x)
    order, values, cut = blobs.split_by((key % U64(p.buckets)).astype(np.int64))
    by_bucket = {bucket: unpack(x) for bucket, _, x in messages(bits, BITS)}
    masks = np.zeros((2, len(key)), bool)
    for i, v in enumerate(values):
        o = order[cut[i] : cut[i + 1]]
        for k in range(2):
            masks[k, o] = np.unpackbits(by_bucket[int(v)][k].astype(np.uint8))[: len(o)].astype(bool)
    cold, hot = key[masks[0] & ~masks[1]], key[masks[1]]
    if len(hot):  # their windows too; short contexts that stand alone pass with them
        x = anchors(b, p, hot)
        return x.where(member(cold, x.key) | (x.hi - x.lo == p.length)), hot
    return x.where(member(cold, x.key)), hot


def hot_message(batch: int, hot: np.ndarray, p: Plan) -> list[tuple]:
    return [(batch % p.buckets, batch, HOT_KEYS, pack(hot))] if len(hot) else []


def hot_keys(table: pa.Table) -> np.ndarray:
    return np.sort(joined(told(table, HOT_KEYS), 1)[0])


def list_contexts(b: Batch, batch: int, bits: pa.Table, p: Plan) -> pa.Table:
    """The contexts that may have another holder: key, hash, the smallest id that holds it here, and is there a larger one?"""
    x, hot = again(b, bits, p)
    context, at, inverse = np.unique(x.context, return_index=True, return_inverse=True)
    key, doc = x.key[at], b.ids[x.doc[at]]
    more = np.zeros(len(context), bool)
    more[inverse[b.ids[x.doc] > doc[inverse]]] = True
    order, values, cut = blobs.split_by((key % U64(p.buckets)).astype(np.int64))
    base = int(b.ids.min()) if len(b.ids) else 0
    sign = np.array([abs(base), int(base < 0)], U64)
    listed = [(int(v), batch, LISTED, pack(sign, key[o], context[o], (doc[o] - base).astype(U64), more[o])) for i, v in enumerate(values) for o in [order[cut[i] : cut[i + 1]]]]
    return rows(listed + hot_message(batch, hot, p))


@dataclass
class Lists:
    """A bucket's lists by key, context and id; `holds` is each line's batch."""

    key: np.ndarray
    context: np.ndarray
    doc: np.ndarray
    more: np.ndarray
    holds: np.ndarray
    first: np.ndarray  # the smallest id that holds the line's context
    opens: np.ndarray  # the line is the first of its context
    wanted: np.ndarray  # the context has another holder, or its anchor another context in another document


def lists_of(table: pa.Table) -> Lists:
    sent = messages(table, LISTED)
    parts = [unpack(x) for _, _, x in sent]
    _, key, context, doc, more = joined(parts, 5)
    doc = doc.astype(np.int64) + np.repeat(np.array([int(x[0][0]) * (-1 if x[0][1] else 1) for x in parts], np.int64), [len(x[1]) for x in parts])
    holds = np.repeat(np.array([b for _, b, _ in sent], np.int64), [len(x[1]) for x in parts])
    order = np.lexsort((holds, doc, context, key))
    key, context, doc, more, holds = key[order], context[order], doc[order], more[order] > 0, holds[order]
    if not len(key):
        return Lists(key, context, doc, more, holds, doc, more, more)
    opens = np.ones(len(key), bool)
    opens[1:] = (key[1:] != key[:-1]) | (context[1:] != context[:-1])
    new_key = np.ones(len(key), bool)
    new_key[1:] = key[1:] != key[:-1]
    by_context, by_key = np.cumsum(opens) - 1, np.cumsum(new_key) - 1
    at, at_key = np.flatnonzero(opens), np.flatnonzero(new_key)
    first, last = doc[at], np.maximum.reduceat(doc, at)
    held = (last > first) | np.logical_or.reduceat(more, at)
    several = (np.add.reduceat(opens.astype(np.int64), at_key) > 1) & (np.minimum.reduceat(doc, at_key) < np.maximum.reduceat(doc, at_key))
    return Lists(key, context, doc, more, holds, first[by_context], opens, held[by_context] | several[by_key])


def ask(table: pa.Table) -> pa.Table:
    """To the batch with the first document that holds a wanted context: send it."""
    x = lists_of(table)
    mine = x.opens & x.wanted
    order, batches, cut = blobs.split_by(x.holds[mine])
    out = [(int(v), int(v), ASKED, pack(x.context[mine][order[cut[i] : cut[i + 1]]])) for i, v in enumerate(batches)]
    return rows(out + [(a, b, HOT_KEYS, blob) for a, b, blob in messages(table, HOT_KEYS)])


def send(b: Batch, batch: int, asked: pa.Table, p: Plan) -> pa.Table:
    """The contents that were asked for: hash, units in each, and the units (bytes, or the words' sizes and bytes)."""
    hot = hot_keys(asked)
    x = anchors(b, p, hot)
    wanted = np.sort(joined(told(asked, ASKED), 1)[0])
    x = x.where(member(wanted, x.context))
    context, at = np.unique(x.context, return_index=True)
    lo, size = x.lo[at], x.hi[at] - x.lo[at]
    order, values, cut = blobs.split_by((x.key[at] % U64(p.buckets)).astype(np.int64))
    out = hot_message(batch, hot, p)
    for i, v in enumerate(values):
        o = order[cut[i] : cut[i + 1]]
        units = stretches(lo[o], size[o])
        if b.unit == "word":
            s, many = b.starts[units], b.ends[units] - b.starts[units]
            blob = pack(context[o], size[o].astype(U64), many.astype(U64), b.data[stretches(s, many)])
        else:
            blob = pack(context[o], size[o].astype(U64), b.data[units])
        out.append((int(v), batch, CONTENT, blob))
    return rows(out)


def stretches(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... start[0] + size[0] - 1, start[1], ..."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def symbols(sizes: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Words (sizes and bytes) as numbers from 0 on, equal for equal words."""
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    return np.asarray(words.dictionary_encode().indices)


def indexed(contents: pa.Table, x: Lists, p: Plan) -> tuple[np.ndarray, ...]:
    """Of the contents, shard by shard: context, its line in the lists, and the stretches in smaller documents, by context."""
    parts = [unpack(blob) for _, _, blob in messages(contents, CONTENT)]
    context, size, *units = joined(parts, 4 if p.unit == "word" else 3)
    size = size.astype(np.int64)
    lines = np.flatnonzero(x.opens)
    lines = lines[np.argsort(x.context[lines], kind="stable")]
    line = lines[np.searchsorted(x.context[lines], context)]
    order = np.argsort(x.key[line], kind="stable")
    begin = np.cumsum(size) - size
    if p.unit == "word":
        word_begin = np.append(0, np.cumsum(units[0].astype(np.int64)))
    found, after = [], np.cumsum(size[order])
    at = 0
    while at < len(order):
        to = max(at + 1, int(np.searchsorted(after, (after[at - 1] if at else 0) + SHARD, "right")))
        while to < len(order) and x.key[line[order[to]]] == x.key[line[order[to - 1]]]:
            to += 1  # all contexts of an anchor are in one shard: at most HOT, or one where it is a window's
        o = order[at:to]
        u = stretches(begin[o], size[o])
        if p.unit == "word":
            many = units[0][u].astype(np.int64)
            u = symbols(many, units[1][stretches(word_begin[u], many)].astype(np.uint8))
        else:
            u = units[0][u].astype(np.uint8)
        entry, lo, hi = p.index(u, size[o], x.first[line[o]], p.length)
        found.append((o[entry], lo, hi))
        at = to
    entry, lo, hi = (np.concatenate([y[i] for y in found]) if found else np.zeros(0, np.int64) for i in range(3))
    return context, line, *runs(entry, lo, hi)


def compare(lists: pa.Table, contents: pa.Table, p: Plan) -> pa.Table:
    """To each batch that holds an indexed context: in which of its documents the whole goes, and which stretches of the first."""
    x = lists_of(lists)
    context, line, entry, lo, hi = indexed(contents, x, p)
    out = [(a, b, HOT_KEYS, blob) for a, b, blob in messages(contents, HOT_KEYS)]
    entry_of = np.full(len(x.context), -1, np.int64)
    entry_of[line] = np.arange(len(line))
    entry_of = entry_of[np.maximum.accumulate(np.where(x.opens, np.arange(len(x.opens)), 0))] if len(x.opens) else entry_of
    parts = np.bincount(entry, minlength=len(context))
    first_part = np.cumsum(parts) - parts
    whole = (entry_of >= 0) & (x.doc > x.first)
    some = (entry_of >= 0) & ~whole
    some[some] &= x.more[some] | (parts[entry_of[some]] > 0)
    for kind, mask in ((WHOLE, whole), (PARTS, some)):
        at = np.flatnonzero(mask)
        order, batches, cut = blobs.split_by(x.holds[at])
        for i, v in enumerate(batches):
            o = at[order[cut[i] : cut[i + 1]]]
            e = entry_of[o]
            if kind == WHOLE:
                out.append((0, int(v), kind, pack(x.context[o])))
            else:
                u = stretches(first_part[e], parts[e])
                out.append((0, int(v), kind, pack(x.context[o], parts[e].astype(U64), lo[u].astype(U64), (hi - lo)[u].astype(U64))))
    return rows(out)


def removed(b: Batch, found: pa.Table, p: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches that go: document, from, to (units of the batch)."""
    x = anchors(b, p, hot_keys(found))
    wholes = np.sort(joined(told(found, WHOLE), 1)[0])
    context, parts, lo, size = joined(told(found, PARTS), 4)
    order = np.argsort(context, kind="stable")
    parts, lo, size = parts.astype(np.int64), lo.astype(np.int64), size.astype(np.int64)
    first_part = np.cumsum(parts) - parts
    whole, some = member(wholes, x.context), member(context[order], x.context)
    s = np.flatnonzero(some)
    values, at, inverse = np.unique(x.context[s], return_index=True, return_inverse=True)
    larger = b.ids[x.doc[s]] > b.ids[x.doc[s[at]]][inverse] if len(s) else np.zeros(0, bool)
    whole[s[larger]] = True
    s = s[~larger]
    line = order[np.searchsorted(context[order], x.context[s])]
    u, many = stretches(first_part[line], parts[line]), parts[line]
    start = np.repeat(x.lo[s], many) + lo[u]
    return runs(np.append(x.doc[whole], np.repeat(x.doc[s], many)), np.append(x.lo[whole], start), np.append(x.hi[whole], start + size[u]))


def without(b: Batch, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What is left of the batch's bytes, and each row's offset in it. Words are joined by one space."""
    n = len(b.tokens)
    edge = np.zeros(n + 1, np.int8)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi, -1)
    keep = np.cumsum(edge[:-1], dtype=np.int8) == 0
    if b.unit == "byte":
        gone = np.bincount(doc, weights=hi - lo, minlength=len(b.ids)).astype(np.int64)
        return b.data[keep], np.append(0, np.cumsum(np.diff(b.first) - gone))
    word = np.flatnonzero(keep)
    row = np.searchsorted(b.first, word, "right") - 1
    space = np.append(row[1:] == row[:-1], False) if len(word) else np.zeros(0, bool)
    s, e = b.starts[word], b.ends[word]
    data = b.data.copy()
    data[e[space]] = 0x20
    edge = np.zeros(len(data) + 2, np.int8)
    np.add.at(edge, s, 1)
    np.add.at(edge, e + space, -1)
    size = np.bincount(row, weights=e + space - s, minlength=len(b.ids)).astype(np.int64)
    return data[np.cumsum(edge[: len(data)], dtype=np.int8) > 0], np.append(0, np.cumsum(size))


def cut(b: Batch, found: pa.Table, carried: list[str], schema: pa.Schema, p: Plan) -> pa.Table:
    doc, lo, hi = removed(b, found, p)
    n, total = len(b.ids), np.diff(b.first)
    data, at = without(b, doc, lo, hi)
    gone = np.bincount(doc, weights=hi - lo, minlength=n).astype(np.int64)
    lo, hi = lo - b.first[doc], hi - b.first[doc]
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["start", "end"]))
    kind = pa.large_binary() if b.unit == "byte" else pa.large_string()
    kept = pa.Array.from_buffers(kind, n, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    columns = {c: b.table.column(c) for c in carried} | {"n_units": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "spans": spans, "kept": kept}
    return pa.Table.from_arrays([columns[f.name].cast(f.type) if f.name != "spans" else columns[f.name] for f in schema], names=schema.names)


def remove_repeats(docs: DataFrame, index: Index, *, unit: str, length: int, gram: int, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 2 << 20, most_bytes: int = 0) -> DataFrame:
    """Every row of docs with n_units, n_removed, spans (removed stretches, in units) and kept (binary for bytes, string for words).

    All windows are judged on the input. A null text is empty; a row whose id is null keeps all and makes no other row
    lose anything; rows that share an id don't affect one another. Input columns named like a new one are replaced, others
    carried, whatever their names; an empty table gives an empty result. A document longer than a batch is a batch by
    itself, and is hashed CHUNK units at a time: a task holds it whole, with about ten bytes more for each word.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    carried = [c for c in docs.columns if c not in ("n_units", "n_removed", "spans", "kept")]
    docs = docs.select(*carried)
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    n, buckets = dealt(spark, size, batch_bytes, most_bytes)
    p = Plan(unit, length, gram, buckets, index)
    tag = next(c for c in (f"__batch{i}" for i in range(len(carried) + 1)) if c not in carried)
    batched = docs.withColumn(tag, F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.col(text_col), F.lit(7)), F.lit(n)).cast("long"))
    blob_type = "bucket long, batch long, kind int, blob binary"
    key = lambda k: int(k[0].as_py())
    load = lambda table: Batch(table, id_col, text_col, unit)

    def counting(k, table):
        return count_anchors(load(table), key(k), p)

    def listing(k, table, bits):
        return list_contexts(load(table), key(k), bits, p) if len(table) else BLOB.empty_table()

    def sending(k, table, asked):
        return send(load(table), key(k), asked, p) if len(table) and len(asked) else BLOB.empty_table()

    out_type = T.StructType([*(T.StructField(f.name, f.dataType) for f in docs.schema), *T._parse_datatype_string(f"n_units long, n_removed long, spans array<struct<start:long,end:long>>, kept {'binary' if unit == 'byte' else 'string'}").fields])
    arrow = to_arrow_schema(out_type)

    def cutting(k, table, found):
        return cut(load(table), found, carried, arrow, p)

    counted = batched.groupBy(tag).applyInArrow(counting, blob_type)
    bits = counted.groupBy("bucket").applyInArrow(census, blob_type)
    listed = batched.groupBy(tag).cogroup(bits.groupBy("batch")).applyInArrow(listing, blob_type)
    asked = listed.groupBy("bucket").applyInArrow(ask, blob_type)
    contents = batched.groupBy(tag).cogroup(asked.groupBy("batch")).applyInArrow(sending, blob_type)
    found = listed.groupBy("bucket").cogroup(contents.groupBy("bucket")).applyInArrow(lambda x, y: compare(x, y, p), blob_type)
    return batched.groupBy(tag).cogroup(found.groupBy("batch")).applyInArrow(cutting, out_type)
