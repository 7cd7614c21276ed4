"""Ledgers of JSON lines, one file for each writer, read permissively or all-or-nothing."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata import schemas


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text, torn): numbered lines of every file; torn marks one that no line feed ends.

    A file is read in its splits, and a line's number is that within its split and the lines of the
    splits before: no file has to fit a row or a task. A file's last line is torn if the lines and
    their line feeds come to more than its bytes.
    """
    m = F.col("_metadata")
    cut = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path).select(m["file_path"].alias("file"), m["file_block_start"].alias("block"), m["file_size"].alias("size"), F.col("value").alias("text"))
    split = cut.groupBy("file", "block", "size").agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + 1).alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    split = split.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("all"), (F.sum("bytes").over(whole) > F.col("size")).alias("torn"))
    own = F.row_number().over(Window.partitionBy("file", "block").orderBy("_i"))
    rows = cut.withColumn("_i", F.monotonically_increasing_id()).withColumn("_r", own).join(split, ["file", "block"])
    at = F.col("before") + F.col("_r")
    return rows.select("file", at.cast("int").alias("line"), "text", (F.col("torn") & (at == F.col("all"))).alias("torn")).where("text <> ''")


def _camel(name: str) -> str:
    return re.sub("_([a-z])", lambda m: m[1].upper(), name)


def _as_written(kind: T.DataType) -> T.DataType:
    """The type with the names that files have: words joined by capitals instead of underscores."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(_camel(f.name), _as_written(f.dataType)) for f in kind.fields])
    return T.ArrayType(_as_written(kind.elementType)) if isinstance(kind, T.ArrayType) else kind


def parsed(rows: DataFrame, schema: str, *, camel: bool = False) -> DataFrame:
    """lines() plus the fields of the schema and _corrupt, the text of what isn't such an object. With
    camel, fields of several words are written joined by capitals (dependsOn) in the files."""
    wanted = T._parse_datatype_string(schema)
    written = _as_written(wanted) if camel else wanted
    with_bad = T.StructType([*written.fields, T.StructField("_corrupt", T.StringType())])
    out = rows.withColumn("r", F.from_json("text", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    fields = [F.col("r").getField(w.name).cast(f.dataType).alias(f.name) for w, f in zip(written.fields, wanted.fields, strict=True)]
    # A parser stops after the first value; as the only element of a list a line must be one value whole.
    one = F.coalesce(F.json_array_length(F.concat(F.lit("["), F.col("text"), F.lit("]"))) == 1, F.lit(False))
    return out.select("file", "line", "torn", "text", *fields, F.when(~one, F.col("text")).otherwise(F.col("r._corrupt")).alias("_corrupt"))


def permissive(rows: DataFrame, schema: str, *required: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose required text fields are there, one row with the number of unreadable lines)."""
    all_ = parsed(rows, schema)
    good = F.col("_corrupt").isNull()
    for c in required:
        good = good & F.col(c).isNotNull()
    return all_.where(good).drop("_corrupt", "text", "torn"), all_.agg(F.count_if(~good).alias("unreadable"))


def damage_codes(**rules: Column) -> Column:
    """array<string> of the names of the rules that hold."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()]))


def canonical_time(at: Column) -> Column:
    """Whether a text is a UTC time with milliseconds, as it would be written."""
    t = F.try_to_timestamp(at, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    return F.coalesce(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") == at, F.lit(False))


def decision_id(r: Column | None = None, digits: int = 8) -> Column:
    """The content id of a decision: NUL-joined fields, optional ones only if they are there."""
    from strata.functions.columns import content_id

    c = lambda n: F.col(n) if r is None else r[n]
    listed = lambda n: F.array_join(F.coalesce(c(n), F.array().cast("array<string>")), "\x01")
    tail = [F.when(F.size(F.coalesce(c("could_be"), F.array().cast("array<string>"))) > 0, listed("could_be")), c("discriminated_by"), c("subject"), c("finding")]
    head = F.concat_ws("\0", *[F.coalesce(c(n), F.lit("")) for n in ("kind", "agent", "chose")], listed("over"), F.coalesce(c("because"), F.lit("")))
    return content_id("d-", digits, F.concat_ws("\0", head, *tail))


def strict_decisions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, damage) of lines(): damage(file, line, code) holds every fault; the rows are there only
    if it is empty.

    Faults: corrupt, torn (no final line feed), missing fields, unknown kinds, times that aren't
    canonical, ids other than the content's, rows in another session's file, conflicting rows of
    one id, references to no row, and kinds that must refer but don't. An id is eight digits of a
    digest, which among a million decisions some share by chance: rows of one id whose whole digests
    differ, and that both are right about it, don't conflict, but a reference to such an id is ambiguous.
    """
    d = parsed(rows, schemas.DECISIONS)
    acting = F.col("kind").isin("retraction", "resolution", "dismissal")
    own = damage_codes(
        corrupt=F.col("_corrupt").isNotNull(), torn=F.col("torn"),
        missing=F.col("id").isNull() | F.col("at").isNull() | F.col("session").isNull() | F.col("chose").isNull(),
        kind=~F.col("kind").isin(*schemas.DECISION_KINDS), time=~canonical_time(F.col("at")), forged=decision_id() != F.col("id"),
        displaced=~F.contains(F.substring_index("file", "/", -1), F.col("session")), reference=acting & F.col("supersedes").isNull(),
    )
    row_faults = d.select("file", "line", F.explode(own).alias("code"))
    body = F.sha2(F.to_json(F.struct(*[c for c in d.columns if c not in ("file", "line", "torn", "text", "_corrupt")])), 256)
    # The whole digest of what an id is right about; all that is wrong about an id counts as one content.
    content = F.when(decision_id() == F.col("id"), decision_id(digits=64))
    each = d.where("id is not null").withColumns({"_body": body, "_content": content}).groupBy("id", "_content").agg(F.count_distinct("_body").alias("n"), F.min(F.struct("file", "line")).alias("at_"))
    same = each.groupBy("id").agg(F.max("n").alias("n"), F.count("*").alias("contents"), F.bool_or(F.col("_content").isNull()).alias("wrong"), F.min("at_").alias("at_")).where("contents > 1 or n > 1")
    clash = F.expr("n > 1 or wrong")
    conflicts = same.where(clash).select("at_.file", "at_.line", F.lit("conflict").alias("code"))
    refers = d.where("supersedes is not null").select("file", "line", F.col("supersedes").alias("id"))
    vague = refers.join(same.where(~clash).select("id"), "id", "left_semi").select("file", "line", F.lit("ambiguous").alias("code"))
    lost = refers.join(d.select("id").distinct(), "id", "left_anti").select("file", "line", F.lit("dangling").alias("code"))
    damage = reduce(DataFrame.unionByName, (row_faults, conflicts, lost, vague))
    return when_sound(d.drop("_corrupt", "text", "torn"), damage), damage


def when_sound(rows: DataFrame, damage: DataFrame) -> DataFrame:
    """rows if damage is empty, none otherwise."""
    gate = damage.agg(F.count("*").alias("_faults")).where("_faults = 0")
    return rows.crossJoin(F.broadcast(gate)).drop("_faults")


def append(rows: DataFrame, path: str, partition: str = "session") -> None:
    """Adds rows as JSON lines in files of their own, one folder for each writer."""
    rows.write.mode("append").partitionBy(partition).json(path)


def append_once(rows: DataFrame, existing: DataFrame, path: str, key: str = "id", partition: str = "session") -> None:
    """append() of what isn't there yet, so that a retry adds nothing."""
    append(rows.dropDuplicates([key]).join(existing.select(key).distinct(), key, "left_anti"), path, partition)


def compaction_plan(files: DataFrame, now: Column, quiet_seconds: int = 7200) -> DataFrame:
    """files(file, branch, month, committed, changed_at, unreadable) plus target and skip: quiet,
    committed, readable files fold into one for each branch and month; skip says why one doesn't."""
    skip = (
        F.when(~F.col("committed"), "never committed").when(F.unix_timestamp(now) - F.unix_timestamp("changed_at") < quiet_seconds, "still warm").when(F.col("unreadable") > 0, "unreadable")
    )
    return files.withColumn("skip", skip).withColumn("target", F.when(skip.isNull(), F.concat_ws("/", "branch", F.concat(F.col("month"), F.lit(".jsonl")))))


def compact(rows: DataFrame, plan: DataFrame, path: str) -> None:
    """Writes the lines of each target, byte for byte, in order of (at, id, session)."""
    moved = rows.join(plan.where("skip is null").select("file", "branch", "month"), "file")
    moved.repartition("branch", "month").sortWithinPartitions("branch", "month", "at", "id", "session").select("branch", "month", F.col("text").alias("value")).write.partitionBy("branch", "month").mode("overwrite").text(path)
