"""Tables between the steps of an operator, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only where it is unset and executors are threads of
    this process a folder of this machine is set instead."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="strata-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def folder(spark: SparkSession, label: str) -> str:
    """A folder of its own for one table."""
    return f"{shared_folder(spark).rstrip('/')}/strata/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: its lineage is cut, and a lost
    executor costs no more than the files it had not yet read."""
    spark = df.sparkSession
    path = folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int | None:
    """The optimizer's estimate of the rows' size, from file sizes; None where it has none."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return None if size > 1 << 57 else size


def large(df: DataFrame) -> DataFrame:
    """df as a side of a join that follows the data: it never goes through the driver. Parquet of numbers in order
    takes a small part of their room in memory, so the planner takes such tables for small."""
    return df.hint("merge")


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df dealt by columns to as many tasks as rows ask for: a million for each, however many there are in all."""
    return df.repartition(max(partitions(df), -(-rows // 1_000_000)), *by)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
