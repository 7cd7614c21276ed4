"""Trees of digests over snapshots of paths: what differs between two is found without reading either whole.

A digest stands for all files under a folder. Trees are written by depth and by a bucket of the folder above,
so that comparing two goes down level by level and reads, of each level, only the buckets that hold children of
folders that differ: what is read follows the size of the change, not that of the snapshots.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.sources.shared import folder, materialize

#: Buckets of each level. Up to as many numbers of buckets reach the driver for each level.
BUCKETS = 256
_NODE = "above string, name string, file boolean, d1 long, d2 long, n long, depth int, bucket int"


@dataclass(frozen=True)
class Tree:
    """A written tree: its folder, the greatest depth of a path in it, and its buckets for each level."""

    path: str
    depth: int
    buckets: int

    def level(self, spark: SparkSession, depth: int, buckets: list[int]) -> DataFrame:
        """The nodes of a level in some buckets. Only their files are opened."""
        if depth > self.depth or not buckets:
            return spark.createDataFrame([], _NODE)
        return spark.read.schema(_NODE).parquet(self.path).where((F.col("depth") == depth) & F.col("bucket").isin(buckets))


def _bucket(above, buckets: int):
    return F.pmod(F.xxhash64(above), F.lit(buckets)).cast("int")


def tree(snapshot: DataFrame, buckets: int = BUCKETS) -> Tree:
    """Writes the tree of snapshot(path, content). A node is a segment under the folder above it; its digest is two
    64-bit sums, in no order, over the paths and contents of all files under it. A file and a folder of one name
    are two nodes. Of rows with one path the greatest content counts; null paths play no part."""
    spark = snapshot.sparkSession
    one = snapshot.where("path is not null").groupBy("path").agg(F.max(F.col("content").cast("string")).alias("content")).withColumn("s", F.split("path", "/", -1))
    h = lambda seed: F.xxhash64(F.lit(seed), "path", F.coalesce("content", F.lit("\0none")))
    nodes = one.select(h(1).alias("h1"), h(2).alias("h2"), "s", F.size("s").alias("k"), F.explode(F.sequence(F.lit(1), F.size("s"))).alias("depth"))
    nodes = nodes.select(F.array_join(F.slice("s", F.lit(1), F.col("depth") - 1), "/").alias("above"), F.get("s", F.col("depth") - 1).alias("name"), (F.col("depth") == F.col("k")).alias("file"), "h1", "h2", "depth")
    summed = nodes.groupBy("depth", "above", "name", "file").agg(F.bit_xor("h1").alias("d1"), F.bit_xor("h2").alias("d2"), F.count("*").alias("n"))
    path = folder(spark, "digests")
    filed = materialize(summed.withColumn("bucket", _bucket(F.col("above"), buckets)), "nodes")
    filed.repartition("depth", "bucket").select("above", "name", "file", "d1", "d2", "n", "depth", "bucket").write.partitionBy("depth", "bucket").parquet(path)
    depth = filed.agg(F.max("depth")).first()[0]
    return Tree(path, depth or 0, buckets) if depth else Tree(path, 0, buckets)


def changed(spark: SparkSession, old: Tree, new: Tree) -> DataFrame:
    """(path, change) of the files that differ: added, removed or changed."""
    if old.buckets != new.buckets:
        raise ValueError("the trees are cut into different numbers of buckets")
    found = spark.createDataFrame([], "path string, change string")
    above = spark.createDataFrame([("",)], "above string")
    for depth in range(1, max(old.depth, new.depth) + 1):
        buckets = sorted(r[0] for r in above.select(_bucket(F.col("above"), old.buckets).alias("b")).distinct().collect())
        if not buckets:
            break
        side = lambda t, mark: t.level(spark, depth, buckets).join(above, "above", "left_semi").select("above", "name", "file", F.struct("d1", "d2", "n").alias(mark))  # noqa: B023, E731
        both = side(old, "x").join(side(new, "y"), ["above", "name", "file"], "full_outer").where(~F.col("x").eqNullSafe(F.col("y")))
        path = F.when(F.lit(depth == 1), F.col("name")).otherwise(F.concat_ws("/", "above", "name"))
        differ = materialize(both.select(path.alias("path"), "file", F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").otherwise("changed").alias("change")), "differ")
        found = found.unionByName(differ.where("file").select("path", "change"))
        above = differ.where("not file").select(F.col("path").alias("above"))
    return found
