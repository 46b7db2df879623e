"""Approximate nearest neighbours by collision counting over single projections.

Every projection is a random direction; vectors sorted by their coordinate on it make one array.  A
query opens a window around its own coordinate in every array and counts, for each vector, the
arrays in which it falls into the window.  Widening all windows at once stands for hashing anew with
wider buckets.  Vectors that collide in at least a given share of the arrays are verified: their
inner product with the query is computed in double precision.  A query is done when it has verified
a given multiple of ``k`` vectors and a given share of the block besides.

Vectors are indexed in blocks of bounded size, each with its own sorted arrays, so the index is
spread over the cluster and no array has to be sorted as a whole; the set of queries is sent to every
block, and each block's best are merged.  Largest inner product becomes nearest neighbour by one
more coordinate that lifts all vectors to the largest norm of their block.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block, and queries sent to a block at a time.
BLOCK_ROWS, GROUP_QUERIES = 8192, 4096
N_PROJECTIONS = 80
#: Share of the arrays in which a vector has to collide.
COLLISIONS = 0.7
#: A query verifies at least this share of a block and so many times ``k`` vectors.
VERIFIED, VERIFIED_TIMES = 0.12, 10
#: First half-width of a window, in the length of the longest vector, and the factor it grows by.
FIRST_WIDTH, WIDER = 0.8, 1.15
#: Steps of a sorted array.
N_STEPS = 256


def is_usable(vector: Column) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0)


class Block:
    """The sorted arrays of one block of vectors.

    An array is kept as the coordinates at its ``N_STEPS`` equal steps and each vector's step in it,
    one byte; windows open and widen step by step.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, n_projections: int, seed: int = 11):
        self.ids, self.vectors = ids, vectors
        self.rough = vectors.astype(np.float32)
        norms = (vectors * vectors).sum(1)
        largest = norms.max()
        lifted = np.column_stack([vectors, np.sqrt(np.maximum(largest - norms, 0))])
        random = np.random.default_rng(seed)
        self.directions = random.standard_normal((lifted.shape[1], n_projections))
        projected = (lifted @ self.directions).T
        places = (np.arange(N_STEPS + 1) * (len(ids) - 1)) // N_STEPS
        self.bounds = np.sort(projected, axis=1)[:, places]
        self.steps = np.stack([np.clip(np.searchsorted(bound, coordinates, "right") - 1, 0, N_STEPS - 1)
                               for bound, coordinates in zip(self.bounds, projected)]).astype(np.uint8)
        self.scale = math.sqrt(float(largest)) or 1.0
        # All arrays' bounds in one ascending row, each array's shifted past the one before.
        reach = np.abs(self.bounds).max() + 1.0
        self.shifts = 4 * reach * np.arange(n_projections)
        self.row = (np.clip(self.bounds, -reach, reach) + self.shifts[:, None]).ravel()
        self.reach, self.firsts = reach, np.arange(n_projections) * (N_STEPS + 1)

    def _places(self, coordinates: np.ndarray, side: str) -> np.ndarray:
        """The step of each array in which a coordinate lies."""
        at = np.clip(coordinates, -self.reach, self.reach) + self.shifts
        places = np.searchsorted(self.row, at, side) - self.firsts - 1
        return np.clip(places, 0, N_STEPS - 1).astype(np.uint8)[:, None]

    def colliding(self, centre: np.ndarray, needed: int, enough: int) -> np.ndarray:
        """Vectors within the windows of ``needed`` arrays, for the narrowest width that gives
        ``enough`` of them."""
        width = FIRST_WIDTH * self.scale
        while True:
            low, high = self._places(centre - width, "left"), self._places(centre + width, "right")
            # Bytes below ``low`` wrap to large ones.
            inside = np.less_equal(self.steps - low, high - low).view(np.uint8)
            found = np.flatnonzero(inside.sum(0, dtype=np.uint8) >= needed)
            if len(found) >= enough or (low == 0).all() and (high == N_STEPS - 1).all():
                return found
            width *= WIDER

    def search(self, query_id: int, query: np.ndarray, k: int, collisions: float,
               verified: float) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and inner products of the best ``k`` found, best first, ties to smaller ids."""
        norm = math.sqrt(float(query @ query))
        # A query's length does not change which inner products are largest.
        centre = np.append(query * (self.scale / norm), 0.0) @ self.directions
        found = self.colliding(centre, math.ceil(collisions * len(self.steps)), min(
            len(self.ids), VERIFIED_TIMES * k + math.ceil(verified * len(self.ids))))
        found = found[self.ids[found] != query_id]
        if len(found) > k:
            # Single precision tells which few can be among the best.
            rough = self.rough[found] @ query.astype(np.float32)
            edge = np.partition(rough, len(found) - k)[len(found) - k]
            found = found[rough >= edge - 1e-4 * self.scale * norm]
        # Sums in one order for all rows: equal vectors have equal scores.
        scores = (self.vectors[found] * query).sum(1)
        best = np.lexsort((self.ids[found], -scores))[:k]
        return self.ids[found[best]], scores[best]


def _one_block(vectors: pd.DataFrame, queries: pd.DataFrame, k: int, n_projections: int,
               collisions: float, verified: float) -> pd.DataFrame:
    if vectors.empty or queries.empty:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"})
    block = Block(vectors["vec_id"].to_numpy(),
                  np.stack(vectors["vector"].to_numpy()).astype(np.float64), n_projections)
    parts = []
    for query_id, query in zip(queries["vec_id"], queries["vector"]):
        ids, scores = block.search(
            query_id, np.asarray(query, np.float64), k, collisions, verified)
        parts.append(pd.DataFrame({"query_id": query_id, "vec_id": ids, "score": scores}))
    return pd.concat(parts, ignore_index=True)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, block_rows: int = BLOCK_ROWS,
            n_projections: int = N_PROJECTIONS, collisions: float = COLLISIONS,
            verified: float = VERIFIED) -> DataFrame:
    """Each query's ``k`` best vectors: ``query_id, rank, vec_id, score``.

    Both tables have ``vec_id`` and ``embedding``; other columns are not read.  Scores are inner
    products in double precision on the original vectors; a query's own row (by ``vec_id``) is no
    candidate.  Vectors that are null, zero or hold null or non-finite components take no part, as
    do rows without a ``vec_id``; vectors of other lengths than the query's are no candidates.  Fewer
    than ``k`` candidates are all returned; repeated rows are candidates each.  No queries or no
    vectors give no rows.
    """
    def usable(df: DataFrame) -> DataFrame:
        return df.where(F.col("vec_id").isNotNull() & is_usable(F.col("embedding"))).select(
            F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"),
            F.size("embedding").alias("dims"))

    vectors, queries = usable(vectors), usable(queries)
    n_blocks = max(1, math.ceil(vectors.count() / block_rows))
    n_groups = max(1, math.ceil(queries.count() / GROUP_QUERIES))
    # Equal vectors lie in all blocks alike: a row's own number deals it.
    dealt = vectors.withColumn("block", F.pmod(
        F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(n_blocks)).cast("int"))
    groups = F.array(*(F.lit(i) for i in range(n_groups))) if n_groups < 100 else F.sequence(
        F.lit(0), F.lit(n_groups - 1))
    left = dealt.withColumn("group", F.explode(groups))
    right = queries.withColumn(
        "group", F.pmod(F.xxhash64("vec_id"), F.lit(n_groups)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    keys = ["block", "group", "dims"]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _one_block(a, b, k, n_projections, collisions, verified)

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
