"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

1. Batches of documents list their distinct shingles with the number of their documents that hold each.
2. By shingle hash, document frequencies are summed; batches get back those of shingles that two documents or more hold.
3. A document can only reach the similarity if such shingles make up that share of its own weight; only then is it sampled.
   Documents with the same weighted shingles form a class at once, and one of them stands for it.
4. Representatives that agree in a band are candidates if they agree in CANDIDATE of all samples. They propose links to those
   that agree with them most, as many as connect all candidates. Buckets of over BLOCK are dealt to blocks, which share a hub.
5. Proposed links are verified on the weighted shingles; connected components of those that hold are the first classes.
6. Where a proposal between two classes failed, its bucket verifies all its candidate pairs between classes. The blocks of a
   bucket that was dealt meet two by two for the same, unless both are of one class. So each candidate pair is connected or
   verified, however large its bucket. Components of all verified links are the classes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs
from .blobs import U64, mix, pack, unpack
from .cluster import saved
from .repeats import BITS, BLOB, COUNTS, Batch, dealt, messages, rows, stretches

BANDS, ROWS = 16, 4
#: Representatives of a bucket that are compared by their samples in one task.
BLOCK = 1024
#: Nearest partners that a representative proposes at first.
NEAREST = 2
#: Share of samples in which candidates agree: of pairs at a similarity of 0.8, one in ten million agrees in less.
CANDIDATE = 34 / 64
#: Representatives of a large bucket in each of two blocks that meet.
MEET = 2048
#: (element, sample) pairs that are drawn at once.
STEP = 1 << 17


def inverse_frequency(df: np.ndarray, n: int) -> np.ndarray:
    """1 + log(n / df) / log(n): 2 for a shingle of one document, 1 for one of all. Bounded, so that a large group of near copies
    does not make what its members share weigh next to nothing."""
    return 1.0 + np.log(n / np.minimum(df, n)) / math.log(max(n, 2))


class Shingles:
    """Distinct word shingles of each document of a batch: hash and count, by document and hash."""

    def __init__(self, b: Batch, width: int):
        n = len(b.ids)
        count = np.diff(b.first)
        h = blobs.RollingHash(b.tokens) if len(b.tokens) <= 1 << 22 else None
        many = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
        start = np.repeat(b.first[:-1] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        size = np.repeat(np.minimum(count, width), many)
        doc = np.repeat(np.arange(n), many)
        gram = np.empty(len(start), U64)
        if h is not None:
            gram[:] = h.of(start, start + size)
        else:
            for a in range(0, len(start), 1 << 20):
                z = min(len(start), a + (1 << 20))
                base = start[a]
                gram[a:z] = blobs.RollingHash(b.tokens[base : start[z - 1] + size[z - 1]]).of(start[a:z] - base, start[a:z] - base + size[a:z])
        gram = mix(gram + size.astype(U64))
        order = np.lexsort((gram, doc))
        gram, doc = gram[order], doc[order]
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        self.gram, self.doc, self.count = gram[at], doc[at], np.diff(np.append(at, len(gram)))
        self.values, self.inverse, self.here = np.unique(self.gram, return_inverse=True, return_counts=True)

    def lists(self, buckets: int):
        """Distinct hashes by bucket, 32 bits of each, with the number of documents: in an order that only depends on them."""
        bucket = (self.values % U64(buckets)).astype(np.int64)
        order, found, cut = blobs.split_by(bucket)
        for i, v in enumerate(found):
            o = order[cut[i] : cut[i + 1]]
            yield int(v), o, self.values[o] >> U64(32), self.here[o]


def frequencies(table: pa.Table) -> pa.Table:
    """For each batch's list: a bit for each of its shingles that two documents or more hold, and the counts of those."""
    sent = messages(table, COUNTS)
    lists = [unpack(x) for _, _, x in sent]
    if not lists:
        return BLOB.empty_table()
    gram, n = (np.concatenate([x[i] for x in lists]) for i in (0, 1))
    _, inverse = np.unique(gram, return_inverse=True)
    total = np.bincount(inverse, weights=n).astype(np.int64)[inverse]
    out, at = [], 0
    for (bucket, batch, _), x in zip(sent, lists, strict=True):
        mine = total[at : at + len(x[0])]
        at += len(x[0])
        out.append((bucket, batch, BITS, pack(np.packbits(mine > 1), mine[mine > 1].astype(U64))))
    return rows(out)


def draw(gram: np.ndarray, weight: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """ICWS of each element under sample j: the logarithm of its hash value (least wins) and its step t."""
    unit = lambda x: (x.astype(np.float64) + 0.5) * 2.0**-32
    a, b = mix(gram ^ U64(2 * j * 0x9E3779B97F4A7C15 % (1 << 64))), mix(gram + U64((2 * j + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64)))
    low = U64(0xFFFFFFFF)
    r = -np.log(unit(a >> U64(32)) * unit(a & low))  # Gamma(2, 1)
    c = -np.log(unit(b >> U64(32)) * unit(b & low))
    beta = unit(mix(a ^ b) >> U64(32))
    t = np.floor(np.log(weight) / r + beta)
    return np.log(c) - r * (t - beta) - r, t.astype(np.int64)


def samples(gram: np.ndarray, weight: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Documents by samples: a hash of the element and step that each sample picks. first: each document's first element."""
    out = np.empty((len(first) - 1, k), U64)
    most = int(np.diff(first).max(initial=0))
    for a, z in _blocks(first, max(STEP, most)):
        g, w, f = gram[first[a] : first[z]], weight[first[a] : first[z]], first[a:z] - first[a]
        doc = np.repeat(np.arange(z - a), np.diff(first[a : z + 1]))
        for j in range(k):
            value, t = draw(g, w, j)
            least = np.minimum.reduceat(value, f)
            at = np.flatnonzero(value == least[doc])
            at = at[np.unique(doc[at], return_index=True)[1]]
            out[a:z, j] = mix(g[at] + t[at].astype(U64) * U64(0xD6E8FEB86659FD93))
    return out


def _blocks(first: np.ndarray, step: int):
    a, n = 0, len(first) - 1
    while a < n:
        z = max(a + 1, int(np.searchsorted(first, first[a] + step, "right")) - 1)
        yield a, z
        a = z


SIGNED = pa.schema([("doc", pa.int64()), ("key1", pa.int64()), ("key2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sample", pa.binary()), ("shingles", pa.binary())])


def sign(b: Batch, answers: pa.Table, n_docs: int, buckets: int, width: int, threshold: float, bands: int, per_band: int) -> pa.Table:
    """A row for each document with words: two hashes of its weighted shingles. If it can have a partner, also a hash of each band,
    a byte of each sample, and the shingles with their weights. Of rows that share an id, that with the least text counts."""
    x = Shingles(b, width)
    df = np.ones(len(x.values), np.int64)
    by_bucket = {bucket: unpack(blob) for bucket, _, blob in messages(answers, BITS)}
    for bucket, o, _, _ in x.lists(buckets):
        bits, counts = by_bucket[bucket]
        several = np.unpackbits(bits.astype(np.uint8))[: len(o)].astype(bool)
        df[o[several]] = counts.astype(np.int64)
    first = np.searchsorted(x.doc, np.arange(len(b.ids) + 1))
    weight = x.count * inverse_frequency(df, n_docs)[x.inverse]
    doc_sum = lambda v: np.add.reduceat(np.append(v, 0), first[:-1]) * (np.diff(first) > 0) if len(b.ids) else np.zeros(0)
    whole, shared = doc_sum(weight), doc_sum(np.where(df[x.inverse] > 1, weight, 0.0))
    item = x.gram * U64(0x9E3779B97F4A7C15) + x.count.astype(U64)
    keys = [np.add.reduceat(np.append(mix(item + U64(s)), U64(0)), first[:-1]) if len(b.ids) else np.zeros(0, U64) for s in (1, 2)]
    good = np.flatnonzero((np.diff(first) > 0) & ~b.null)
    good = good[np.unique(b.ids[good], return_index=True)[1]]
    can = good[shared[good] >= (threshold - 1e-9) * whole[good]]
    size = np.diff(first)[can]
    pick = stretches(first[can], size)
    got = samples(x.gram[pick], weight[pick], np.append(0, np.cumsum(size)), bands * per_band)
    rank = {d: i for i, d in enumerate(can.tolist())}
    level = np.rint(weight * 4096).astype(U64)
    band = np.zeros((len(can), bands), U64)
    for k in range(per_band):
        band = mix(band + got.reshape(len(can), bands, per_band)[:, :, k])
    band, byte = band.view(np.int64), (got & U64(255)).astype(np.uint8)
    some = lambda f: [f(rank[d], d) if d in rank else None for d in good.tolist()]
    content = some(lambda i, d: pack(x.gram[first[d] : first[d + 1]] >> U64(16), level[first[d] : first[d + 1]]))
    columns = [b.ids[good], keys[0][good].view(np.int64), keys[1][good].view(np.int64), some(lambda i, d: band[i].tolist()), some(lambda i, d: byte[i].tobytes()), content]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SIGNED, strict=True)], schema=SIGNED)


def sample_bytes(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sample").to_pylist()), np.uint8).reshape(len(table), -1)


def agreement(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Documents by documents: the number of samples in which two agree."""
    out = np.zeros((len(p), len(q)), np.uint8)
    for j in range(p.shape[1]):
        out += p[:, j][:, None] == q[:, j][None]
    return out


def joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Component labels (smallest members) after the links i, j."""
    while len(i):
        least = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, before[i], least)
        np.minimum.at(label, before[j], least)
        while (label[label] != label).any():
            label = label[label]
        label = label[label]
        if (label == before).all():
            break
    return label


def propose(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links to verify among the documents of a block, as places i and j.

    Each document proposes its nearest partners by samples and the block's hub, which agrees with the others most; and while a
    candidate pair is left between two components, the best such pair of each. So if all proposals are verified, the components
    are those of all candidate pairs.
    """
    n = len(s)
    label = np.arange(n)
    w = agreement(s, s).astype(np.int16)
    hub = int(w.sum(1).argmax())
    w[(w < CANDIDATE * s.shape[1]) | (label[:, None] == label[None])] = -1
    star = np.flatnonzero(w[hub] >= 0)
    k = min(NEAREST, n - 1)
    i, j = np.repeat(np.arange(n), k), np.argpartition(-w, k - 1, axis=1)[:, :k].ravel()
    keep = w[i, j] >= 0
    i, j = np.append(i[keep], star), np.append(j[keep], np.full(len(star), hub))
    label = joined(label, i, j)
    while True:
        w[label[:, None] == label[None]] = -1
        partner = w.argmax(1)
        value = w[np.arange(n), partner]
        order = np.lexsort((-value, label))
        head = order[np.unique(label[order], return_index=True)[1]]
        head = head[value[head] >= 0]
        if not len(head):
            break
        i, j = np.append(i, head), np.append(j, partner[head])
        label = joined(label, head, partner[head])
    pair = np.unique(np.minimum(i, j) * n + np.maximum(i, j))
    return pair // n, pair % n


def hub_of(table: pa.Table) -> int:
    """The document that holds the commonest samples."""
    table = table.sort_by("doc")
    s = sample_bytes(table)
    votes = np.zeros(len(s), np.int64)
    for j in range(s.shape[1]):
        votes += np.bincount(s[:, j], minlength=256)[s[:, j]]
    return table.column("doc")[int(votes.argmax())].as_py()


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def propose_block(table: pa.Table) -> pa.Table:
    """propose() on a block's rows."""
    doc, order = np.unique(np.asarray(table.column("doc")), return_index=True)
    if len(doc) == 2:  # most blocks; two of a band that are no candidates cost one vain check
        return pa.table([doc[:1], doc[1:]], schema=PAIRS)
    i, j = propose(sample_bytes(table)[order]) if len(doc) > 1 else (doc[:0], doc[:0])
    return pa.table([doc[i], doc[j]], schema=PAIRS)


def settle_block(table: pa.Table, threshold: float) -> pa.Table:
    """Links between the classes (root) of a block's documents: of all candidate pairs, those that reach the threshold and join two classes."""
    doc, order = np.unique(np.asarray(table.column("doc")), return_index=True)
    s = sample_bytes(table)[order]
    w = agreement(s, s)
    label = first_of_class(np.asarray(table.column("root"))[order])
    i, j = np.nonzero(np.triu((w >= CANDIDATE * s.shape[1]) & (label[:, None] != label[None]), 1))
    return settled(doc, table.column("shingles").take(pa.array(order)), label, i, j, w[i, j], threshold)


def first_of_class(root: np.ndarray) -> np.ndarray:
    _, head, label = np.unique(root, return_index=True, return_inverse=True)
    return head[label]


def settled(doc: np.ndarray, shingles: pa.ChunkedArray, label: np.ndarray, i: np.ndarray, j: np.ndarray, agree: np.ndarray, threshold: float) -> pa.Table:
    """Of the pairs i, j (places), those that reach the threshold and join two classes; label is the place of a class's first document."""
    best = np.argsort(-agree.astype(np.int16), kind="stable")
    sets, links, parent = {}, [], label.tolist()

    def shingles_of(d: int) -> list[np.ndarray]:
        if d not in sets:
            if len(sets) >= MEET:
                sets.clear()
            sets[d] = unpack(shingles[d].as_py())
        return sets[d]

    for x, y in zip(i[best].tolist(), j[best].tolist(), strict=True):
        p, q = x, y
        while parent[p] != p:
            p = parent[p]
        while parent[q] != q:
            q = parent[q]
        if p != q and similarity(shingles_of(x), shingles_of(y)) >= threshold:
            parent[max(p, q)] = min(p, q)
            links.append((int(doc[x]), int(doc[y])))
    return pa.table([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], schema=PAIRS)


def meeting(table: pa.Table, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and agreement of the candidate pairs of different classes (root) between the sides 0 and 1 of two blocks that meet
    in a band, or inside side 0 alone. Pairs that share an earlier band are left to that."""
    s, root, side = sample_bytes(table), np.asarray(table.column("root")), np.asarray(table.column("side"))
    p, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alone = not len(q)
    q = p if alone else q
    same = agreement(s[p], s[q])
    can = (same >= CANDIDATE * s.shape[1]) & (root[p][:, None] != root[q][None])
    i, j = np.nonzero(np.triu(can, 1) if alone else can)
    if band and len(i):
        every = np.asarray(pc.list_flatten(table.column("bands"))).reshape(len(table), -1)
        keep = np.ones(len(i), bool)
        for a in range(0, len(i), 1 << 16):
            z = slice(a, a + (1 << 16))
            keep[z] = ~(every[p[i[z]], :band] == every[q[j[z]], :band]).any(1)
        i, j = i[keep], j[keep]
    return p[i], q[j], same[i, j]


def settle_meeting(table: pa.Table, band: int, threshold: float) -> pa.Table:
    """Links between the classes of two blocks that meet: of all candidate pairs, those that reach the threshold and join two classes."""
    i, j, agree = meeting(table, band)
    return settled(np.asarray(table.column("doc")), table.column("shingles"), first_of_class(np.asarray(table.column("root"))), i, j, agree, threshold)


def meetings(members: DataFrame) -> DataFrame:
    """Rows (i, h, doc, root), dealt to blocks of about MEET, by the pairs of blocks that must meet: i, h, pair, side, doc, root.

    A class of over half a block in a bucket has blocks of its own, which need not meet each other; the others share blocks.
    """
    band = ["i", "h"]
    sizes = members.groupBy(*band, "root").agg(F.count("*").alias("n"))
    own = F.col("n") > MEET // 2
    unit = F.struct(own.alias("own"), F.when(own, F.col("root")).otherwise(F.lit(0)).alias("of"))
    sizes = saved(sizes.select(*band, "root", unit.alias("unit"), "n"))
    parts = sizes.groupBy(*band, "unit").agg(F.ceil(F.sum("n") / MEET).alias("parts"))
    blocks = parts.select(*band, F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda k: F.struct("unit", k.alias("part")))).alias("p"))
    apart = (F.col("p") <= F.col("q")) & ~(F.col("p.unit.own") & (F.col("p.unit") == F.col("q.unit")))
    pairs = blocks.join(blocks.withColumnRenamed("p", "q"), band).where(apart)
    ends = pairs.select(*band, F.explode(F.when(F.col("p") == F.col("q"), F.array(F.struct(F.col("p").alias("block"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("p").alias("block"), F.lit(0).alias("side")), F.struct(F.col("q").alias("block"), F.lit(1).alias("side"))))).alias("end"), F.xxhash64("p", "q").alias("pair"))
    dealt = members.join(sizes, [*band, "root"]).join(parts, [*band, "unit"])
    dealt = dealt.select(*band, F.struct("unit", F.pmod(F.xxhash64("doc", F.lit(3)), F.col("parts")).alias("part")).alias("block"), "doc", "root")
    return dealt.join(ends.select(*band, "end.block", "end.side", "pair"), [*band, "block"]).select(*band, "pair", "side", "doc", "root")


def similarity(x: list[np.ndarray], y: list[np.ndarray]) -> float:
    """Weighted Jaccard similarity of two shingle lists (hash, weight)."""
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(x[1][i], y[1][j]).astype(np.int64).sum())
    either = float(x[1].sum()) + float(y[1].sum()) - both
    return both / either if either else 0.0


def components(links: DataFrame) -> DataFrame:
    """doc, root: for every document but the smallest of its component, that smallest one. Links are (a, b).

    Large and small stars by turns: every document's larger neighbours, then its smaller ones, are linked to the smallest of
    all instead. Each keeps what is connected, and the links end as stars around the smallest documents.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = saved(small.union(least).distinct())
        ends = edges.select(F.col("u").alias("doc"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)).distinct())
        if ends.groupBy("doc").agg(F.count("*").alias("n"), F.sum("up").alias("up")).where("n > 1 AND up > 0").isEmpty():
            return edges.select(F.col("u").alias("doc"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, bands: int = BANDS, rows_per_band: int = ROWS, batch_bytes: int = 2 << 20) -> DataFrame:
    """id and class_id, the smallest id of its class.

    Similarity is the weighted Jaccard of TF-IDF weights over distinct shingles of `width` words (a shorter text is one shingle).
    Documents with no words (null, empty or blank texts) are classes of their own, and rows whose id is null are left out. An id that
    several rows share is one document, with the least of their texts. An empty table gives an empty result; other columns are left out.
    A text of any length is one item of a batch.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where(F.col("doc").isNotNull())
    whole = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n_docs = max(1, whole["n"])
    n, buckets = dealt(spark, whole["bytes"] or 0, batch_bytes)
    batched = docs.withColumn("__batch", F.pmod(F.xxhash64("doc", F.lit(7)), F.lit(n)).cast("long"))
    load = lambda table: Batch(table, "doc", "text", "word")

    def count(key, table):
        return rows([(v, int(key[0].as_py()), COUNTS, pack(gram, here.astype(U64))) for v, _, gram, here in Shingles(load(table), width).lists(buckets)])

    def finish(key, table, answers):
        return sign(load(table), answers, n_docs, buckets, width, threshold, bands, rows_per_band)

    counted = batched.groupBy("__batch").applyInArrow(count, "bucket long, batch long, kind int, blob binary")
    answers = counted.groupBy("bucket").applyInArrow(frequencies, "bucket long, batch long, kind int, blob binary")
    signed = saved(batched.groupBy("__batch").cogroup(answers.groupBy("batch")).applyInArrow(finish, "doc long, key1 long, key2 long, bands array<long>, sample binary, shingles binary"))

    same = saved(signed.groupBy("key1", "key2").agg(F.min("doc").alias("head")))
    heads = saved(signed.where("bands IS NOT NULL").join(same.select(F.col("head").alias("doc")), "doc", "left_semi").select("doc", "bands", "sample", "shingles"))
    signature, sets = heads.select("doc", "bands", "sample"), heads.select("doc", "shingles")

    band = ["i", "h"]
    keyed = heads.select("doc", F.posexplode("bands").alias("i", "h"))
    sizes = keyed.groupBy(*band).agg(F.count("*").alias("n")).where("n > 1")
    salt = F.pmod(F.xxhash64("doc", F.lit(5)), F.ceil(F.col("n") / BLOCK)).alias("salt")
    blocks = saved(keyed.join(sizes, band).select(*band, salt, "doc", "n"))
    large = saved(blocks.where(F.col("n") > BLOCK).select(*band, F.ceil(F.col("n") / BLOCK).alias("blocks")).distinct())
    any_large = not large.isEmpty()
    tags, kind = [*band, "salt"], "i int, h long, salt long, a long, b long"
    if any_large:
        # one block of a large bucket, a uniform part of it, names a hub, which is then in each of its blocks
        def named(key, t):
            return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "h": pa.array([key[1].as_py()], pa.int64()), "doc": pa.array([hub_of(t)], pa.int64())})

        hubs = blocks.where((F.col("n") > BLOCK) & (F.col("salt") == 0)).join(signature, "doc").groupBy(*band).applyInArrow(named, "i int, h long, doc long")
        everywhere = hubs.join(large, band).select(*band, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("salt"), "doc", F.lit(0).cast("long").alias("n"))
        blocks = saved(blocks.union(everywhere))

    def proposing(key, t):
        found = propose_block(t)
        return pa.table([*[pa.array([k.as_py()] * len(found), x) for k, x in zip(key, (pa.int32(), pa.int64(), pa.int64()), strict=True)], *found.columns], names=[*tags, "a", "b"])

    proposed = saved(blocks.join(signature, "doc").groupBy(*tags).applyInArrow(proposing, kind))

    def verify(batches):
        for x in batches:
            t = pa.Table.from_batches([x])
            ok = [similarity(unpack(p), unpack(q)) >= threshold for p, q in zip(t.column("shingles").to_pylist(), t.column("other").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"a": x.column("a"), "b": x.column("b"), "ok": pa.array(ok, pa.bool_())})

    # each link goes to the smaller id with the other's shingles
    sent = proposed.select("a", "b").distinct().join(sets.withColumnRenamed("doc", "b"), "b").select("a", "b", F.col("shingles").alias("other"))
    checked = saved(sent.join(sets.withColumnRenamed("doc", "a"), "a").mapInArrow(verify, "a long, b long, ok boolean"))
    root = components(checked.where("ok"))

    def rooted(df, doc="doc", name="root"):
        """df with the root of a document; a document without links is its own."""
        out = df.join(root.select(F.col("doc").alias(doc), F.col("root").alias("__root")), doc, "left")
        return out.withColumn(name, F.coalesce("__root", doc)).drop("__root")

    # whole buckets where a proposal between two classes failed verify all their candidates between classes
    failed = rooted(rooted(checked.where("NOT ok"), "a", "ra"), "b", "rb").where("ra <> rb").select("a", "b")
    bad = proposed.join(failed, ["a", "b"], "left_semi").select(*tags).distinct()
    bad = bad.join(large, band, "left_anti") if any_large else bad
    members = rooted(blocks.join(bad, tags, "left_semi").join(heads.drop("bands"), "doc"))
    more = saved(members.groupBy(*tags).applyInArrow(lambda t: settle_block(t, threshold), "a long, b long"))
    as_links = lambda: root.select(F.col("doc").alias("a"), F.col("root").alias("b"))
    if not more.isEmpty():
        root = components(as_links().union(more))
    if any_large:
        # what is not connected yet in large buckets: their blocks meet two by two, first by samples, then candidates with their shingles
        met = meetings(saved(rooted(keyed.join(large.select(*band), band, "left_semi"))))
        place = "i int, h long, pair long"

        def candidates(key, t):
            i, j, _ = meeting(t, key[0].as_py())
            t = t.take(pa.array(np.unique(np.append(i, j))))
            return pa.table([*[pa.array([k.as_py()] * len(t), x) for k, x in zip(key, (pa.int32(), pa.int64(), pa.int64()), strict=True)], t.column("side"), t.column("doc"), t.column("root")], names=["i", "h", "pair", "side", "doc", "root"])

        some = saved(met.join(signature, "doc").groupBy(*band, "pair").applyInArrow(candidates, place + ", side int, doc long, root long"))
        more = saved(some.join(heads, "doc").groupBy(*band, "pair").applyInArrow(lambda key, t: settle_meeting(t, key[0].as_py(), threshold), "a long, b long"))
        if not more.isEmpty():
            root = components(as_links().union(more))
    member = signed.select("doc", "key1", "key2").join(same, ["key1", "key2"]).select("doc", "head")
    classes = rooted(member, "head", "class_id").select("doc", "class_id")
    # roots of heads are heads; a class's smallest id is that of its smallest head
    everyone = docs.select("doc").distinct().join(classes, "doc", "left")
    return everyone.select(F.col("doc").alias(id_col), F.coalesce("class_id", "doc").alias("class_id"))
