"""Connected components by alternating stars, as joins and minima over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.store import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every lesser neighbour of a node, and the node, is tied to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root): the least node of the component of each node that an edge (a, b) touches.

    Edges are longs in any direction and number. The edges shrink to stars in rounds that grow
    with the logarithm of the longest path; a round keeps minima only, so a node with very many
    neighbours is a partly summed group and a join side that can be split. The driver sees a
    count and a sum for each round.
    """
    now = materialize(edges.select("a", "b").where("a <> b").distinct(), f"{label}-0")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    seen, turn = None, 0
    while True:
        turn += 1
        now = materialize(_small_star(_large_star(now)), f"{label}-{turn}")
        if (found := tuple(mark(now))) == seen:
            break
        seen = found
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
