"""Connected components over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.core import cut, join_groups


def _least_neighbours(edges: DataFrame) -> DataFrame:
    """Per u: the least of u and its neighbours, and how many neighbours; aggregated before any shuffle."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"), F.count("*").alias("n"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(id, component) for every id on an edge; component is its least id. Nulls and loops are no edges.

    Alternating large and small stars (Kiveris et al. 2014): the edges of each id move to the least id near it, in
    O(log n) rounds whatever the diameter. Each round starts from a table in the shared folder. Ids whose edges are
    a large share of all are joined by broadcasting those few ids.
    """
    edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u") != F.col("v"))
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        total = edges.count()
        if not total:
            break
        large = join_groups(both, _least_neighbours(both), ["u"], "n", 2 * total).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where(F.col("u") != F.col("v")).distinct())
        least = _least_neighbours(large)
        small = join_groups(large, least, ["u"], "n", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut(small.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == tuple(now):
            break
        state = tuple(now)
    else:
        raise RuntimeError(f"components haven't settled in {rounds} rounds")
    members = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return members.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
