"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITIES = (512, 1024, 2048, 4096)
#: Cost of a sequence besides its tokens, in tokens.
OVERHEAD = 32
SPACE = " \t\n\x0b\f\r"


def n_words(text: Column) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, "[ \\t-\\r]+"))).cast("long")


def cost(capacity: int, overhead: int) -> int:
    return capacity + overhead


def opened(item: int, small: int, capacities: tuple[int, ...], overhead: int) -> int:
    """The permitted length of least cost a token, if what is free beside item is filled by the `small` tokens still to come."""
    return min((c for c in capacities if c >= item), key=lambda c: (cost(c, overhead) / (item + min(c - item, small)), c))


def best_fit(sizes: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and each bin's capacity. Items are taken largest first; each goes where it leaves least room.

    Bins with the same room form a stack, and the bits of one integer tell which rooms there are. At the end each bin shrinks
    to the least permitted length that holds its contents.
    """
    capacities = tuple(sorted(capacities))
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    size_of, used, stacks, rooms = [], [], {}, 0
    left = int(sizes.sum())
    for i in order.tolist():
        s = int(sizes[i])
        left -= s
        if fits := rooms >> s:
            room = s + ((fits & -fits).bit_length() - 1)
            b = stacks[room].pop()
            if not stacks[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(size_of), opened(s, left, capacities, overhead)
            size_of.append(room)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += s
        if room := room - s:
            stacks.setdefault(room, []).append(b)
            rooms |= 1 << room
    filled = np.array(used, np.int64)
    return bins, offsets, np.array(capacities)[np.searchsorted(capacities, filled)] if len(filled) else np.zeros(0, np.int64)


def pack_documents(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, *, id_col: str = "doc_id", length: Column | None = None, text_col: str = "text", overhead: int = OVERHEAD, shard_tokens: int = 4_000_000) -> DataFrame:
    """One row for each piece of a document: id, piece, start, n_tokens, bin_id, bin_capacity, bin_offset.

    A document longer than the largest capacity is cut into pieces of that size and a rest. Documents without tokens (null
    or empty texts) get no row, as does an empty table. Documents are dealt evenly to shards of about shard_tokens by a hash
    of their rows' places, each shard is packed by itself, and bin_id holds the shard, so no bin is shared. Repeated rows are packed each. Other
    columns are left out.
    """
    capacities = tuple(sorted(set(capacities)))
    most = capacities[-1]
    lengths = docs.select(F.col(id_col).alias("__id"), (n_words(F.col(text_col)) if length is None else length.cast("long")).alias("__n")).where(F.col("__n") > 0)
    from .cluster import saved

    lengths = saved(lengths).withColumn("__row", F.monotonically_increasing_id())
    total = lengths.agg(F.sum("__n").alias("n")).first()["n"] or 0
    shards = max(1, -(-total // shard_tokens))
    whole = F.floor((F.col("__n") + most - 1) / most).cast("int")
    dealt = lengths.withColumn("__piece", F.explode(F.sequence(F.lit(0), whole - 1)))
    # by row (in the order that is saved) and piece, so that no shard grows with one document or one id
    dealt = dealt.withColumn("__shard", F.pmod(F.xxhash64("__row", "__piece"), F.lit(shards)).cast("long"))
    dealt = dealt.withColumn("__size", F.least(F.col("__n") - F.col("__piece").cast("long") * most, F.lit(most)))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("__size", "descending"), ("__id", "ascending"), ("__piece", "ascending")])
        sizes = np.asarray(table.column("__size"))
        bins, offsets, room = best_fit(sizes, capacities, overhead)
        shard = np.asarray(table.column("__shard"))
        piece = table.column("__piece").cast(pa.int64())
        return pa.table({"id": table.column("__id"), "piece": piece, "start": np.asarray(piece) * most, "n_tokens": sizes, "bin_id": (shard << 32) + bins, "bin_capacity": room[bins], "bin_offset": offsets})

    kind = docs.schema[id_col].dataType.simpleString()
    out = dealt.select("__id", "__piece", "__shard", "__size").groupBy("__shard").applyInArrow(pack, f"id {kind}, piece long, start long, n_tokens long, bin_id long, bin_capacity long, bin_offset long")
    return out.withColumnRenamed("id", id_col)
