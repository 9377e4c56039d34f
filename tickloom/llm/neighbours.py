"""Nearest neighbours by collision counting.

Inner products become distances on a sphere: vectors are scaled by the largest norm and given one more coordinate that fills their norm up to 1,
queries are scaled to 1 with that coordinate 0. Each of ``PROJECTIONS`` random directions keeps the vectors of a block sorted by their
projection. A query looks at a window around its own projection in every such array. Widening all windows by a factor (virtual rehashing: no
table is built anew) makes vectors collide with the query in more and more arrays; those that collide in ``THRESHOLD`` of the arrays are
verified by their exact inner product, until the k-th best found is better than what a vector outside all windows can be expected to reach. Where
most of a block has collided already, the rest is verified at once.

Queries and vectors are dealt to blocks of bounded size, and each pair of blocks is one task; a query's best of all blocks are merged.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.scratch import written
from tickloom.llm.text import column

PROJECTIONS = 32
THRESHOLD = 0.5  # share of the arrays in which a vector must collide
NARROW, WIDEN = 0.5, 1.4  # half width of the first windows, on the unit sphere, and factor of each round
MOST = 0.5  # share of a block's vectors beyond which the rest is verified too instead of being counted further
CERTAINTY = 1.3  # how far the windows must go beyond the k-th best distance, in its standard deviations along a projection
SPREAD = 64.0  # no projection of a unit vector is beyond it, short of one chance in very many; what is, is clipped
BLOCK_VECTORS, BLOCK_QUERIES = 12_000, 4_000


@lru_cache
def directions(width: int) -> np.ndarray:
    return np.random.default_rng(width).standard_normal((width, PROJECTIONS))


class Index:
    """Sorted projections of a block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm: float):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.norm = ids[order], vectors[order], norm
        scaled = self.vectors / norm
        rest = np.sqrt(np.maximum(1 - (scaled**2).sum(1), 0))
        self.projected = np.concatenate([scaled, rest[:, None]], 1) @ directions(vectors.shape[1] + 1)
        self.order = np.argsort(self.projected, axis=0, kind="stable").T.astype(np.int32).copy()
        # One ascending array: projections lie within -SPREAD..SPREAD, and array j is moved up by 2 * j * SPREAD.
        self.shift = 2 * SPREAD * np.arange(PROJECTIONS)
        self.sorted = (np.clip(np.sort(self.projected, axis=0).T, -SPREAD, SPREAD) + self.shift[:, None]).ravel()
        self.flat = self.order.ravel()

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of the best ``k`` found, best first, ties by smaller id; the query's own id is left out."""
        n, need = len(self.ids), int(np.ceil(THRESHOLD * PROJECTIONS))
        length = np.sqrt((query**2).sum())
        at = np.concatenate([query / length, [0.0]]) @ directions(len(query) + 1)
        half, own = NARROW, self.ids == query_id
        counted, score = np.zeros(n, np.int64), np.full(n, -np.inf)
        todo, others = ~own, n - int(own.sum())
        low = high = np.searchsorted(self.sorted, np.clip(at, -SPREAD, SPREAD) + self.shift)
        found = 0
        while found < others:
            a, b = np.searchsorted(self.sorted, np.stack([np.maximum(at - half, -SPREAD) + self.shift, np.minimum(at + half, SPREAD) + self.shift]))
            fresh = [self.flat[x:y] for x, y in zip(np.concatenate([a, high]), np.concatenate([low, b])) if y > x]  # what the wider window adds
            low, high = a, b
            if fresh:
                counted += np.bincount(np.concatenate(fresh), minlength=n)
            verify = np.flatnonzero(todo & (counted >= need))
            if found + len(verify) > MOST * others:
                verify = np.flatnonzero(todo)
            score[verify] = self.vectors[verify] @ query
            todo[verify] = False
            found += len(verify)
            if found >= k:
                kth = np.partition(score, n - k)[n - k]
                if half >= CERTAINTY * np.sqrt(max(2 - 2 * kth / (length * self.norm), 0)):
                    break
            half *= WIDEN
        seen = np.flatnonzero(~todo & ~own)
        if len(seen) > k:  # all that can be among the best, whatever the rounding of the products above
            seen = seen[score[seen] >= np.partition(score[seen], len(seen) - k)[len(seen) - k] - 1e-9 * length * self.norm]
        exact = (self.vectors[seen] * query).sum(1)
        best = np.lexsort((self.ids[seen], -exact))[:k]
        return self.ids[seen[best]], exact[best]


def nearest(vectors: DataFrame, queries: str, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which the SQL condition ``queries`` holds, the ``k`` other rows of largest inner product.

    Approximate (see the tests for recall); scores are exact, in double precision. Nearest first, ties to the smaller id; all candidates if
    there are fewer. Null, zero-length, zero or partly null or non-finite vectors and null ids take no part, nor do vectors of another
    length than most. Of rows with one id and different vectors each is a candidate; a query's own id is none. Other columns are not read. Nothing gives
    no rows.
    """
    v = F.transform(vector_column, lambda x: x.cast("double"))
    clean = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v"), F.expr(queries).alias("asks")).where("id is not null and v is not null")
    clean = clean.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)).dropDuplicates(["id", "v"])
    clean = written(clean.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))), "vectors")
    about = clean.agg(F.count("*").alias("n"), F.count_if("asks").alias("q"), F.max("norm").alias("norm"), F.mode(F.size("v")).alias("width")).first()
    names = "query_id bigint, vec_id bigint, score double"
    if not about.n or not about.q:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    norm, width = float(about.norm), int(about.width)
    v_blocks, q_blocks = -(-about.n // BLOCK_VECTORS), -(-about.q // BLOCK_QUERIES)
    clean = clean.where(F.size("v") == width)
    deal = lambda blocks, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    held = clean.select(deal(v_blocks, 1).alias("vb"), every(q_blocks).alias("qb"), "id", "v")
    asked = clean.where("asks").select(every(v_blocks).alias("vb"), deal(q_blocks, 2).alias("qb"), "id", "v")

    def matrix(t: pa.Table) -> np.ndarray:
        return np.asarray(t.column("v").combine_chunks().flatten(), np.float64).reshape(-1, width)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            index = Index(left.column("id").to_numpy(), matrix(left), norm)
            for q, x in zip(right.column("id").to_numpy(), matrix(right)):
                ids, scores = index.search(int(q), x, k)
                out[0].append(np.full(len(ids), q))
                out[1].append(ids)
                out[2].append(scores)
        parts = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.table({"query_id": pa.array(parts[0], pa.int64()), "vec_id": pa.array(parts[1], pa.int64()), "score": pa.array(parts[2], pa.float64())})

    found = held.groupBy("vb", "qb").cogroup(asked.groupBy("vb", "qb")).applyInArrow(search, names)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
