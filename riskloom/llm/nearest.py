"""Approximate nearest neighbours by collision-counting hashing.

Each of ``PROJECTIONS`` random directions keeps the vectors' projections in a
sorted array.  A query looks at a window around its own projection in each of
them; growing all windows together is rehashing at a larger radius without
building anything anew.  Vectors that fall into enough windows are verified by
their exact cosine.  The threshold is set so that a vector within the radius is
missed with probability ``MISS``, and the search ends at the first radius that
holds as many verified vectors as are wanted.

Vectors and queries are dealt to blocks; each pair of blocks is one task's
search, and the best of every query over all blocks are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import materialize, narrow, table
from .vectors import matrix, usable

PROJECTIONS = 64
#: Half a window's width at radius 1, in units of the radius.
HALF_WIDTH = 1.0
#: Chance that a vector at the radius stays below the collision threshold, in standard deviations.
MISS = 2.6
FIRST_RADIUS, GROWTH = 0.3, 1.2
#: Rows of a block of vectors: a sixteenth of all, between these.
LEAST_BLOCK, MOST_BLOCK = 2_048, 65_536
QUERY_BLOCK = 4_096
#: Above twice any projection of a unit vector; above what the order of a sum may change.
_APART, _ROUNDING = 1_000.0, 1e-9
_INSIDE = 0.6826894921370859  # of a normal variable, within one standard deviation: HALF_WIDTH's collision probability


class CollisionIndex:
    """Sorted projections of a block of unit vectors."""

    def __init__(self, vectors: np.ndarray, seed: int = 42):
        self.vectors = vectors
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        n, dims = vectors.shape
        self.directions = np.random.default_rng([seed, dims]).standard_normal((dims, PROJECTIONS))
        projected = (vectors / self.norms[:, None]) @ self.directions
        self.order = np.argsort(projected, axis=0, kind="stable").T.copy().astype(np.int32)
        # One array after the other, each moved to a range of its own: one binary search serves all windows.
        self.shift = _APART * np.arange(PROJECTIONS)
        self.sorted = (np.take_along_axis(projected, self.order.T.astype(np.int64), axis=0) + self.shift).T.ravel()
        self.order = self.order.ravel()
        self.needed = int(np.floor(PROJECTIONS * _INSIDE - MISS * np.sqrt(PROJECTIONS * _INSIDE * (1 - _INSIDE))))

    def search(self, query: np.ndarray, k: int, skip: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of about the ``k`` nearest; ``skip`` is a place that takes no part."""
        n = len(self.vectors)
        norm = np.sqrt((query * query).sum())
        at = (query / norm) @ self.directions + self.shift
        low = high = np.searchsorted(self.sorted, at)
        hits = np.zeros(n, np.int32)
        verified = np.zeros(n, bool)
        cosine = np.full(n, -np.inf)
        if skip is not None:
            verified[skip] = True
        radius = FIRST_RADIUS
        while True:
            half = HALF_WIDTH * radius
            wider, higher = np.searchsorted(self.sorted, at - half), np.searchsorted(self.sorted, at + half, side="right")
            parts = [self.order[a:b] for a, b in zip([*wider, *high], [*low, *higher])]
            low, high = wider, higher
            hits += np.bincount(np.concatenate(parts), minlength=n).astype(np.int32)
            new = np.nonzero((hits >= self.needed) & ~verified)[0] if radius < 2 else np.nonzero(~verified)[0]
            if len(new):
                verified[new] = True
                cosine[new] = self.vectors.take(new, axis=0) @ query / (self.norms[new] * norm)
            inside = 1 - radius * radius / 2
            if radius >= 2 or (cosine >= inside - _ROUNDING).sum() >= k:
                break
            radius *= GROWTH
        found = np.nonzero(cosine > -np.inf)[0]
        if len(found) > k:
            edge = np.partition(cosine[found], len(found) - k)[len(found) - k]
            found = found[cosine[found] >= edge - _ROUNDING]
        # Summed row by row, so that equal vectors have equal cosines.
        return found, (self.vectors[found] * query).sum(axis=1) / (self.norms[found] * norm)


def _search_block(k: int):
    def each(block: pa.Table) -> pa.Table:
        asks = np.asarray(block.column("asks"))
        ids, dims = np.asarray(block.column("vec_id")), block.column("dims")[0].as_py()
        vectors = matrix(block.column("vector"), dims)
        own = ids[~asks]
        out: list[tuple[np.ndarray, ...]] = []
        if len(own) and asks.any():
            index = CollisionIndex(vectors[~asks])
            place = {int(v): i for i, v in enumerate(own)}
            for query_id, query in zip(ids[asks], vectors[asks]):
                found, cosine = index.search(query, k, place.get(int(query_id)))
                best = np.lexsort((own[found], -cosine))[:k]
                out.append((np.full(len(best), query_id), own[found][best], cosine[best]))
        columns = [np.concatenate([o[i] for o in out]) if out else np.zeros(0) for i in range(3)]
        return pa.table({"query_id": pa.array(columns[0].astype(np.int64)), "vec_id": pa.array(columns[1].astype(np.int64)), "score": pa.array(columns[2].astype(np.float64))})

    return each


def nearest_neighbours(df: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for the rows where ``queries`` holds, the ``k`` nearest others found.

    ``queries`` is a condition on the column ``vec_id``.  Nearest first, ties to
    the smaller id; all candidates if there are fewer.  Vectors that are null,
    zero or hold null or non-finite components, and rows without an id, take no
    part; vectors of different lengths are not compared.  Rows that share an id
    are one vector, the smallest.  An empty table gives an empty one.
    """
    rows = narrow(df, vec_id=vec_id, vector=vector).select(F.col("vec_id").cast("long"), "vector").where(F.col("vec_id").isNotNull() & usable("vector"))
    rows = materialize(rows.groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("dims", F.size("vector")), "nearest-vectors")
    asking = rows.where(queries)
    n, asked = rows.count(), asking.count()
    size = min(MOST_BLOCK, max(LEAST_BLOCK, n // 16))
    blocks, query_blocks = max(1, -(-n // size)), max(1, -(-asked // QUERY_BLOCK))
    dealt = lambda salt, many: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(many)).cast("int")
    every = rows.select("*", F.lit(False).alias("asks"), dealt(1, blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"))
    asks = asking.select("*", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), dealt(2, query_blocks).alias("query_block"))
    found = every.unionByName(asks).groupBy("dims", "block", "query_block").applyInArrow(_search_block(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 50, among all others."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
