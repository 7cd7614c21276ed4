"""The driver's tables in the roles of the library's logical tables. Operators stay generic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_path(key: str = "p_partkey"):
    return F.concat(F.lit("p:"), F.col(key))


def supplier_path(key: str = "s_suppkey"):
    return F.concat(F.lit("s:"), F.col(key))


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hash"), part_path("l_partkey").alias("path"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(part_path().alias("path"), F.col("p_brand").alias("component"), F.col("p_size").cast("long").alias("lines"))
    makers = table(spark, sf_dir, "supplier").select(supplier_path().alias("path"), F.concat(F.lit("n:"), F.col("s_nationkey")).alias("component"), F.col("s_nationkey").cast("long").alias("lines"))
    return parts.unionByName(makers)


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(supplier_path("l_suppkey").alias("source"), part_path("l_partkey").alias("target")).distinct()


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest first by (date, key); ord sorts, it isn't a number."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hash"), F.struct((-F.unix_timestamp("o_orderdate")).alias("t"), (-F.col("o_orderkey")).alias("k")).alias("ord"))


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c: F.sum(F.when(c, F.col("l_quantity")).otherwise(0.0))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("hash")).agg(n(F.col("l_returnflag") == "N").alias("added"), n(F.col("l_returnflag") != "N").alias("deleted"))


def prose_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as units: id `doc:line`, file the document."""
    from strata.functions.columns import normalize_words

    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "said"))
    return lines.select(F.concat_ws(":", "doc_id", "line").alias("id"), F.col("doc_id").alias("file"), normalize_words(F.col("said")).alias("words"))


def domain_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sites: the parts of an order are its keys."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("keys"))
    return rows.where(F.size("keys") >= 3).select(
        F.col("l_orderkey").alias("id"), F.concat(F.lit("o"), F.col("l_orderkey")).alias("name"),
        F.element_at(F.array(*[F.lit(x) for x in ("union", "shape", "table", "md-table", "switch")]), (F.col("l_orderkey") % 5 + 1).cast("int")).alias("kind"),
        (F.col("l_orderkey") % 7).alias("file"), F.col("keys").cast("array<string>").alias("keys"), F.lit(None).cast("string").alias("type_link"),
    )


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?://", ""), r"[?#].*$|/$", "").alias("path"))
