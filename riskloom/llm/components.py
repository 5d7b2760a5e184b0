"""Connected components of an edge table, without a driver-side graph.

Alternating star contraction: each round a node hands its larger neighbours to
its smallest one, then its smaller neighbours likewise; the rounds needed grow
with the logarithm of the graph's size, not with its diameter.  Minima are
taken by partial aggregation, so that a node with very many edges does not meet
in one task, and each round's edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialize


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _smallest(both).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = _smallest(edges)
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", label: str = "components") -> DataFrame:
    """``(node, root)`` for every node that has an edge to another node.

    ``root`` is the smallest node reachable.  Edges with a null end and loops
    are ignored, repeated edges count once, an empty table gives an empty one.
    """
    ends = edges.select(F.col(f"`{a}`").alias("p"), F.col(f"`{b}`").alias("q")).where("p <> q")
    now = materialize(ends.select(F.greatest("p", "q").alias("u"), F.least("p", "q").alias("v")).distinct(), label)
    before = _digest(now)
    while before[0]:
        now = materialize(_small_star(_large_star(now)), label)
        after = _digest(now)
        if after == before:
            break
        before = after
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
