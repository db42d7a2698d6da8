"""Approximate nearest neighbours by largest inner product: collision-counting hashing on sorted projections.

A vector x becomes (x, sqrt(M^2 - |x|^2)) with M the largest norm, and a query is scaled to norm M, so the largest
inner product is the least distance. Each of `m` Gaussian projections keeps a block's vectors in sorted order. Around
a query's own projection a window of one radius is opened in every sorted array; a vector collides where it lies in
the window, that is, where its rank is between the window's ends. The radius starts where windows hold a little more than half of
the block and grows by `step` (virtual rehashing: nothing is hashed again) until at least `share` of the block, and `least` more, have `alpha`
* m collisions; all of these are verified by the inner product in double precision on the original vectors.

Equal vectors are one class, of which the 21 smallest ids are kept: a query returns 20, and its own is not one of
them, so no more can ever be needed. Classes and distinct queries are dealt to blocks by a hash; every block of
vectors meets every block of queries, and each pair returns its best classes only.

`share` is there for vectors without any structure, as random ones in many dimensions, whose nearest are hardly nearer
than others: a smaller one verifies less and finds less. Neither it nor a block's size leaves a vector out of the index.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part; a query's candidates are
the vectors of its own length; rows that share a vec_id and a vector count once, those of one vec_id with other vectors
are other candidates, but never of a query of that vec_id; fewer candidates than asked for are all returned; equal
scores go to the smaller vec_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table


class SortedProjections:
    """The index of one block."""

    def __init__(self, x: np.ndarray, longest: float, m: int = 128, seed: int = 11):
        self.x, self.longest = x, longest
        full = np.c_[x, np.sqrt(np.maximum(longest**2 - np.einsum("ij,ij->i", x, x), 0))]
        self.a = np.random.default_rng(seed).standard_normal((full.shape[1], m))
        self.sorted, self.rank, places = np.empty((m, len(x))), np.empty((m, len(x)), np.uint16), np.arange(len(x), dtype=np.uint16)
        for s, r, a in zip(self.sorted, self.rank, self.a.T):  # one at a time: the arrays that sorting needs are as long as a block
            at = full @ a
            order = np.argsort(at, kind="stable")
            s[:], r[order] = at[order], places

    def nearest(self, queries: np.ndarray, k: int, held: int = 64):
        """For each query in turn, the places and scores of its best k, ties by place; what is found is held for so many queries only."""
        for i in range(0, len(queries), held):
            for found, score in self.search(queries[i : i + held], k):
                take = np.argsort(-score, kind="stable")[:k]
                yield found[take], score[take]

    def search(self, queries: np.ndarray, k: int, alpha: float = 0.56, share: float = 0.25, least: int = 100, step: float = 1.12):
        """For each query, the places and scores of the vectors found: at least min(k, all) of them, and a share of the block."""
        n, m = len(self.x), len(self.a[0])
        at = (np.c_[queries * (self.longest / np.sqrt((queries * queries).sum(axis=1)))[:, None], np.zeros(len(queries))] @ self.a).T
        want, need = min(n, k + least + int(share * n)), int(np.ceil(alpha * m))
        some = self.sorted[:, :: max(1, n // 64)]
        radius = np.array([max(1e-12, 1.06 * np.median(np.abs(some - at[:, [i]]))) for i in range(len(queries))])
        out: list = [None] * len(queries)
        left, shift, inside = np.arange(len(queries)), np.empty(n, np.uint16), np.empty(n, bool)
        while len(left):
            lo = np.stack([np.searchsorted(s, v - radius[left]) for s, v in zip(self.sorted, at[:, left])])
            wide = np.stack([np.searchsorted(s, v + radius[left]) for s, v in zip(self.sorted, at[:, left])]) - lo
            lo, wide, again = lo.astype(np.uint16), np.minimum(wide, 65_535).astype(np.uint16), []
            for c, i in enumerate(left.tolist()):
                count = np.zeros(n, np.uint8 if m < 256 else np.uint16)
                for r, a, w in zip(self.rank, lo[:, c], wide[:, c]):
                    np.less(np.subtract(r, a, out=shift), w, out=inside)
                    np.add(count, inside, out=count)
                found = np.flatnonzero(count >= need)
                if len(found) >= want:
                    out[i] = found, self.x[found] @ queries[i]
                else:
                    again.append(i)
            left = np.array(again, int)
            radius[left] *= step
        return out


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in column.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = 65_536, query_block: int = 16_384, tasks: int = 12, m: int = 128) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found; both tables have vec_id and embedding."""
    ok = lambda x: x.isNotNull() & (x != float("inf")) & (x != float("-inf")) & ~F.isnan(x)
    e = F.col("embedding").cast("array<double>")
    clean = lambda d: d.select(F.col("vec_id").cast("bigint").alias("vec_id"), e.alias("e")).where(F.forall("e", ok) & F.exists("e", lambda x: x != 0) & F.col("vec_id").isNotNull())
    v = clean(vectors)
    h = lambda d: d.withColumn("h0", F.xxhash64("e")).withColumn("h1", F.xxhash64(F.lit(1), "e"))
    kept = Window.partitionBy("h0", "h1").orderBy("vec_id")
    named = saved(h(v).dropDuplicates(["vec_id", "h0", "h1"]).withColumn("at", F.row_number().over(kept)).where(F.col("at") <= k + 1), "vectors")
    q = saved(h(clean(queries)).select("vec_id", "h0", "h1", "e"), "queries")
    asked = q.dropDuplicates(["h0", "h1"])
    top = named.agg(F.sum((F.col("at") == 1).cast("int")).alias("n"), F.max(F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x))).alias("longest")).first()
    n, longest = top["n"] or 0, top["longest"] or 0.0
    n_blocks = max(1, -(-n // block), min(tasks // 3, n // 4_096))
    n_parts = max(1, -(-asked.count() // query_block), -(-tasks // n_blocks))
    spread = lambda d, n, other, many: d.withColumn("dims", F.size("e")).withColumn(n, F.pmod("h0", F.lit(many[0]))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(many[1] - 1))))
    left = spread(named.where("at = 1").select("vec_id", "e", "h0"), "b", "p", (n_blocks, n_parts)).withColumn("p", F.col("p").cast("bigint"))
    right = spread(asked.select("h0", "h1", "e"), "p", "b", (n_parts, n_blocks)).withColumn("b", F.col("b").cast("bigint"))

    def best(x: pa.Table, y: pa.Table) -> pa.Table:
        ids, scores, h0, h1 = [], [], [], []
        if x.num_rows and y.num_rows:
            names = x.column("vec_id").to_numpy()
            order = np.argsort(names)  # places in the order of ids, so that a stable sort breaks ties by id
            names = names[order]
            index = SortedProjections(_matrix(x.column("e"))[order], longest, m)
            for found, score in index.nearest(_matrix(y.column("e")), k + 1):
                ids.append(names[found])
                scores.append(score)
            sizes = [len(i) for i in ids]
            h0, h1 = (np.repeat(y.column(c).to_numpy(), sizes) for c in ("h0", "h1"))
        joined = lambda parts, t: pa.array(np.concatenate(parts) if len(parts) else [], t)
        return pa.table([pa.array(h0, pa.int64()), pa.array(h1, pa.int64()), joined(ids, pa.int64()), joined(scores, pa.float64())], names=["h0", "h1", "rep", "score"])

    near = left.groupBy("dims", "b", "p").cogroup(right.groupBy("dims", "b", "p")).applyInArrow(best, "h0 bigint, h1 bigint, rep bigint, score double")
    first = Window.partitionBy("h0", "h1").orderBy(F.desc("score"), "rep")
    near = near.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).select("h0", "h1", "rep", "score")
    of = named.select("vec_id", F.min("vec_id").over(Window.partitionBy("h0", "h1")).alias("rep2"))
    rows = near.join(of, F.col("rep") == F.col("rep2")).select("h0", "h1", "vec_id", "score")
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("h0", "h1").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    back = q.select(F.col("vec_id").alias("query_id"), F.col("h0").alias("q0"), F.col("h1").alias("q1")).distinct()
    out = rows.join(back, (F.col("h0") == F.col("q0")) & (F.col("h1") == F.col("q1"))).where("vec_id <> query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return search(v, v.where("vec_id % 20 = 0"))
