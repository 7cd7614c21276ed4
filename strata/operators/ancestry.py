"""Ancestry in a commit graph with merges.

The graph is covered by chains: a commit goes on the chain of its first parent unless another child of
that parent does. Whatever a commit reaches of a chain is the chain up to some place, so what it reaches
altogether is one number for each chain it meets, and is found in as many rounds as there are merges inside
merges, however long the chains are. The chains themselves take rounds in the logarithm of their length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.graph import root_of
from strata.sources.shared import large, materialize


def chains(commits: DataFrame) -> DataFrame:
    """(hash, chain, pos) of commits(hash, parents): chain is the hash of its first commit, pos counts from 0.
    Parents that aren't commits of the table count as none; of children with one first parent the least hash goes on."""
    known = large(commits.select(F.col("hash").alias("first")))
    first = commits.select("hash", F.get("parents", F.lit(0)).alias("first")).join(known, "first", "left_semi")
    onward = first.groupBy("first").agg(F.min("hash").alias("id"))
    links = commits.select(F.col("hash").alias("id")).join(large(onward.select("id", F.col("first").alias("parent"))), "id", "left").select("id", "parent")
    return root_of(links).select(F.col("id").alias("hash"), F.col("root").alias("chain"), F.col("hops").alias("pos"))


def crossings(commits: DataFrame, places: DataFrame) -> DataFrame:
    """(chain, pos, other, upto): edges from a commit to a parent in another chain."""
    edges = commits.select("hash", F.explode("parents").alias("parent"))
    child, parent = places.toDF("hash", "chain", "pos"), places.toDF("parent", "other", "upto")
    return edges.join(large(child), "hash").join(large(parent), "parent").where("chain <> other").groupBy("chain", "pos", "other").agg(F.max("upto").alias("upto"))


def reached(commits: DataFrame, refs: DataFrame, places: DataFrame) -> DataFrame:
    """(hash, chain, upto) for each of refs(hash): it and its ancestors in that chain are those at upto and before.

    In each round, what was found last (from the place known before up to the new one) is followed
    over the edges that leave there, until nothing goes further. Unknown refs have no rows.
    """
    cross = materialize(crossings(commits, places), "crossings")
    found = frontier = materialize(refs.select("hash").distinct().join(large(places), "hash").select("hash", "chain", F.col("pos").alias("upto"), F.lit(-1).cast("long").alias("since")), "reached")
    while True:
        step = frontier.join(large(cross.toDF("chain", "pos", "other", "to")), "chain").where("since < pos and pos <= upto").groupBy("hash", F.col("other").alias("chain")).agg(F.max("to").alias("upto"))
        new = step.join(large(found.select("hash", "chain", F.col("upto").alias("had"))), ["hash", "chain"], "left").where("had is null or upto > had")
        frontier = materialize(new.select("hash", "chain", "upto", F.coalesce("had", F.lit(-1)).cast("long").alias("since")), "reached")
        if frontier.isEmpty():
            return found.select("hash", "chain", "upto")
        found = materialize(found.unionByName(frontier).groupBy("hash", "chain").agg(F.max("upto").alias("upto")).withColumn("since", F.lit(-1).cast("long")), "reached")


def ancestors_of(pairs: DataFrame, labels: DataFrame, places: DataFrame) -> DataFrame:
    """pairs(hash, other) plus is: whether other is hash or an ancestor of it, by the labels that reached() gives for the
    hashes; null if either is unknown."""
    at = pairs.join(large(places.toDF("other", "chain", "pos")), "other", "left").join(large(labels), ["hash", "chain"], "left")
    known = labels.select("hash").distinct().withColumn("_known", F.lit(True))
    rows = at.join(large(known), "hash", "left")
    there = F.coalesce(F.col("upto") >= F.col("pos"), F.lit(False))
    return rows.select("hash", "other", F.when(F.col("_known") & F.col("pos").isNotNull(), there).alias("is"))


def commits_since(commits: DataFrame, refs: DataFrame, head: DataFrame) -> DataFrame:
    """(hash, n) of refs(hash): how many commits the one of head(hash) has that the ref hasn't; null for a ref that is
    unknown or off the head's history."""
    places = materialize(chains(commits), "chains")
    wanted = refs.select("hash").distinct()
    labels = materialize(reached(commits, wanted.unionByName(head.select("hash")), places), "labels")
    size = labels.groupBy("hash").agg(F.sum(F.col("upto") + 1).alias("size"))
    top = head.select("hash").join(large(labels), "hash").select("chain", F.col("upto").alias("top"))
    on = wanted.join(large(places), "hash").join(large(top), "chain").where("pos <= top").select("hash").join(large(size), "hash")
    total = head.select("hash").join(large(size), "hash").agg(F.max("size").alias("total"))
    counted = on.crossJoin(F.broadcast(total)).select("hash", (F.col("total") - F.col("size")).alias("n"))
    return refs.select("hash").join(large(counted), "hash", "left")
