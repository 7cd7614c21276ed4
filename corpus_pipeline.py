"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir) that works on all rows it is given; run() writes
what a stage returns as Parquet in the shared folder and hands the next stage that table. All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.language import identify
from strata.llm.neardup import classes
from strata.llm.packing import pack
from strata.llm.quality import quality
from strata.llm.store import materialize
from strata.llm.substrings import dedup_substrings
from strata.llm.tokens import public_path

#: Below this probability of the likeliest language a document goes.
LEAST_LANGUAGE = 0.4


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language that the network is fairly sure of, go. If no
    row outside the held-out third has a language, there is no network and only those without a
    letter go."""
    found = identify(docs, untrained=None)
    sure = (F.col("li_lang") != "und") & (F.col("li_score") >= LEAST_LANGUAGE)
    return found.where(F.col("li_lang").isNull() | sure).select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; documents that fail the base rules or lose too much go. Others are unchanged."""
    changed = F.col("q_lost") > 0
    out = quality(docs).where("q_kept").withColumns(
        {"text": F.when(changed, F.col("q_clean_text")).otherwise(F.col("text")), "n_chars": F.when(changed, F.length("q_clean_text").cast("long")).otherwise(F.col("n_chars"))}
    )
    return out.select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class the document with the least id stays (if that id has several texts in the class,
    one of them), and of repeated rows one. Rows with one id and texts of different classes are
    different documents. Rows with a null id are no duplicates."""
    found = materialize(classes(docs), "classes").where("doc_id is not null")
    first = found.where("nd_group is not null").groupBy("nd_group").agg(F.min(F.struct("doc_id", "nd_text")).alias("first")).select("first.*")
    first = first.unionByName(found.where("nd_group is null").select("doc_id", "nd_text").distinct())
    kept = docs.withColumn("nd_text", F.xxhash64("text")).join(first, ["doc_id", "nd_text"], "left_semi")
    one = kept.withColumn("nd_row", F.row_number().over(Window.partitionBy("doc_id", "nd_text").orderBy("text"))).where("nd_row = 1").select(*docs.columns)
    return one.unionByName(docs.where("doc_id is null"))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that a document with a smaller id has go; a document without any left goes."""
    changed = F.col("sd_n_removed") > 0
    out = dedup_substrings(docs).where(~changed | (F.col("sd_kept") != "")).withColumns(
        {"text": F.when(changed, F.col("sd_kept")).otherwise(F.col("text")), "n_chars": F.when(changed, F.length("sd_kept").cast("long")).otherwise(F.col("n_chars"))}
    )
    return out.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    return pack(docs, public_path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_stage),
    ("quality_rules", quality_stage),
    ("minhash_neardup", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("bestfit_packing", packing_stage),
]

#: A trained network, a tokenizer and arbitrary sequence numbers can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
