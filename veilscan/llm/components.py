"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import forget, materialize

MAX_ROUNDS = 50


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (``a``, ``b``: long) as ``node``, ``component`` (its smallest node).

    Each round links every node's larger neighbours, then its smaller ones, to its smallest; the
    number of rounds grows with the logarithm of the longest path.  Rounds are written to the shared
    folder.  Should they not settle, which no table of up to 2 ** 50 nodes gives, that is an error.  A
    node that very many share is only ever the smaller end after the first round, where
    sums and minima are combined before the shuffle.
    """
    current = materialize(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select(
            "a", F.least("a", "least").alias("least"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = large.where("a <> b").distinct()
        # Now a > b.  Small star: a and all its smaller neighbours to the smallest of them.
        smallest = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(smallest, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        small = small.where("a <> b").unionByName(
            smallest.select("a", F.col("least").alias("b"))).distinct()
        following = materialize(small, "edges")
        changed = following.join(current, ["a", "b"], "left_anti").limit(1).count() or (
            following.count() != current.count())
        forget(current)
        current = following
        if not changed:
            break
    else:
        raise RuntimeError(f"components are not settled after {MAX_ROUNDS} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
