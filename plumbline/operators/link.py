"""Linking records: connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", rounds: int = 40) -> DataFrame:
    """(node, component): every node of ``edges`` with the least node of its component.

    Alternating large-star and small-star steps, which converge in a number of rounds that grows with the
    logarithm of the longest chain; labels stay in the cluster and every round is written to the
    checkpoint folder.  Edges with a null end are left out, an edge from a node to itself makes it a
    component, repeated edges change nothing, and without edges the result is empty.
    """
    pairs = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where(
        F.col(left).isNotNull() & F.col(right).isNotNull()
    )
    pairs = cut_lineage(pairs.distinct())
    state, stars = None, pairs.where("u <> v")
    for _ in range(rounds):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # every greater neighbour goes to the least one; what goes nowhere else is kept by the node itself
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"), F.col("u").alias("w"))
        kept = small.select(F.explode(F.array("u", "w")).alias("u"), "v").where("u <> v")
        stars = cut_lineage(kept.distinct())
        seen = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("u", "v"), 32))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"components did not converge in {rounds} rounds")
    # in a forest of stars every node but the centres has one edge, to its centre
    centres = pairs.select(F.explode(F.array("u", "v")).alias("node"))
    return (
        stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .unionByName(centres.select("node", F.col("node").alias("component")))
        .groupBy("node")
        .agg(F.min("component").alias("component"))
    )
