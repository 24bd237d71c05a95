"""Exact top-k inner products by multi-resolution segment statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import saved

#: Vectors in a block of candidates, and queries in a block.
ROWS, QUERIES = 4096, 1024
#: Segments at each resolution.
SEGMENTS = (2, 8)
LARGEST = 2.0**53


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component, in double precision."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """For each segment: its mean and its standard deviation, each times the root of its length. Rows of x are vectors.

    An inner product is the sum over segments of length * mean * mean plus that of the deviations, which Cauchy and Schwarz
    bound by length * deviation * deviation: the product of two rows of statistics bounds that of the vectors from above, as the
    distance of segment means and deviations bounds the distance of vectors from below.
    """
    cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    parts = [x[:, a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return np.hstack([np.column_stack([p.mean(1), p.std(1)]) * np.sqrt(p.shape[1]) for p in parts])


def best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, candidate's id, score) of each query's k highest products with other rows, ties to smaller ids.

    Upper bounds at the coarsest resolution name the k most likely rows; their exact products set the threshold below which
    no row can matter. Bounds of each finer resolution are only taken where the coarser left a row, products at the end.
    """
    out = []
    order = np.argsort(row_ids, kind="stable")
    rows, row_ids = rows[order], row_ids[order]
    big = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * rows.shape[1]
    exact = big < LARGEST
    levels = [(statistics(queries, s), statistics(rows, s)) for s in SEGMENTS]
    slack = 1e-9 * (1 + big)
    bounds = levels[0][0] @ levels[0][1].T
    for q in range(len(queries)):
        bound = bounds[q]
        bound[row_ids == query_ids[q]] = -np.inf
        n = min(k, int(np.isfinite(bound).sum()))
        if not n:
            continue
        likely = np.argpartition(-bound, n - 1)[:n]
        floor = (rows[likely] @ queries[q]).min()
        at = np.flatnonzero(bound >= floor - slack)
        for a, b in levels[1:]:
            at = at[b[at] @ a[q] >= floor - slack]
        score = rows[at] @ queries[q] if exact else np.array([sum(int(x) * int(y) for x, y in zip(rows[i].tolist(), queries[q].tolist(), strict=True)) for i in at])
        top = np.lexsort((row_ids[at], -score))[:k]
        out.append((np.full(len(top), q), row_ids[at][top], score[top].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def block(table: pa.Table, column: str) -> np.ndarray:
    a = table.column(column).combine_chunks()
    a = pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) else a
    return np.asarray(a.flatten(), np.float64).reshape(len(a), -1)


def exact_top_k(vectors: DataFrame, k: int = 20, *, id_col: str = "vec_id", vector_col: str = "embedding", query_every: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank (from 1), <id>, score: for each row whose id is divisible by query_every, its k highest integer inner
    products with rows of other ids, of all rows; ties go to the smaller id, and all are returned if they are fewer than k.

    Vectors that are null, or hold null or non-finite components, take no part, nor do null ids; vectors only meet those of
    their own dimension. Of rows that share an id, each is a candidate for other ids, and the one with the least vector is the query.
    An empty table gives an empty result; other columns are left out. Blocks of queries meet blocks of rows by a join on the query block's number; a block's best are merged by query.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    ok = F.forall("v", lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    v = saved(v.where(ok & (F.size("v") > 0)).select("id", quantised(F.col("v"), scale).cast("array<double>").alias("v"), F.size("v").alias("dim")))
    asked = v.where(F.pmod("id", F.lit(query_every)) == 0).groupBy("id", "dim").agg(F.min("v").alias("v"))
    n, m = v.count(), asked.count()
    parts, shares = max(8, -(-n // ROWS)), max(1, -(-m // QUERIES))
    by = lambda c, count: F.pmod(F.xxhash64(c, F.lit(3)), F.lit(count)).cast("long")
    rows = v.withColumn("part", by("id", parts)).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    asks = asked.withColumn("share", by("id", shares)).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def meet(queries, rows):
        found = []
        for d in set(queries.column("dim").to_pylist()) & set(rows.column("dim").to_pylist()):
            q, r = (t.filter(pc.equal(t.column("dim"), d)) for t in (queries, rows))
            ids = np.asarray(q.column("id"))
            place, row, score = best(block(q, "v"), ids, block(r, "v"), np.asarray(r.column("id")), k)
            found.append(pa.table({"query_id": pa.array(ids[place], pa.int64()), "row_id": pa.array(row, pa.int64()), "score": pa.array(score, pa.int64())}))
        return pa.concat_tables(found) if found else pa.schema([("query_id", pa.int64()), ("row_id", pa.int64()), ("score", pa.int64())]).empty_table()

    near = asks.groupBy("share", "part").cogroup(rows.groupBy("share", "part")).applyInArrow(meet, "query_id long, row_id long, score long")

    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "row_id")
    out = near.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", F.col("row_id").alias(id_col), "score")
