"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.plans.shape import discard, shuffles_for, stored


def _both_ways(links: DataFrame) -> DataFrame:
    back = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return links.union(back)


def _contract(links: DataFrame, larger_only: bool) -> DataFrame:
    """Link neighbours of each node straight to the node's least neighbour (or to itself).

    ``larger_only``: every node moves its larger neighbours; else it moves itself and its smaller ones.
    The least neighbour is an aggregate with map-side combine, and the join back to the links is a
    plain equi-join, so that a node with very many neighbours can be split at run time.
    """
    if larger_only:
        pairs = _both_ways(links)
        least = pairs.groupBy("a").agg(F.min("b").alias("_m"))
        moved = pairs.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "_m").alias("b"))
    else:
        pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = pairs.groupBy("a").agg(F.min("b").alias("_m"))
        below = pairs.join(least, "a").where("b > _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        moved = below.union(least.select("a", F.col("_m").alias("b")))
    return moved.where("a != b").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``; the component is its least node.

    Large-star and small-star steps alternate until the links no longer change; each round is a
    stored table. Null ends and self-links are ignored.
    """
    now = stored(links.select("a", "b").where("a != b").distinct())
    with shuffles_for(now.sparkSession, now.count()):
        mark = None
        for _ in range(rounds):
            last, now = now, stored(_contract(_contract(now, True), False))
            discard(last)
            new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if tuple(new) == mark:
                break
            mark = tuple(new)
        else:
            raise RuntimeError("links did not settle")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(now.select(F.col("b"), F.col("b")).distinct())
