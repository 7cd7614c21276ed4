"""Single JSON records: status, baselines and cursors; and small path tables."""

from __future__ import annotations

import json
import os
import tempfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.history import places


def read(path: str) -> dict | list | None:
    """A record: None if absent; a damaged one is refused, never taken for an empty one."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except FileNotFoundError:
        return None
    except ValueError as e:
        raise ValueError(f"{path} can't be read: {e}") from e


def write(path: str, record: dict | list) -> None:
    """Replaces a record in one step, so that no reader sees half of it."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    fd, made = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        json.dump(record, f, indent=2, sort_keys=True, ensure_ascii=False)
        f.write("\n")
    os.replace(made, path)


def stamp(path: str, section: str, values: dict, at: str, commit: str | None) -> None:
    """Replaces one section of a status record; the others stay."""
    record = read(path) or {"version": 1}
    write(path, record | {section: values | {"at": at, "commit": commit}})


def baseline(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A pinned list of rows; None if there is none."""
    rows = read(path)
    return None if rows is None else spark.createDataFrame([json.dumps(r) for r in rows], "string").select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def pin(path: str, rows: DataFrame, key: str) -> None:
    """Writes a baseline in key order. Baselines are small by nature: one row for each pinned thing."""
    write(path, [json.loads(r[0]) for r in rows.orderBy(key).select(F.to_json(F.struct("*"))).toLocalIterator()])


def refuse_vacuous(live: int, pinned: int | None) -> str | None:
    """Why a scan that found nothing mustn't replace a baseline that remembers something."""
    return f"nothing was found where {pinned} were pinned" if live == 0 and pinned else None


def union_paths(*tables: DataFrame) -> DataFrame:
    """Distinct paths of several tables(path)."""
    return reduce(DataFrame.unionByName, [t.select("path") for t in tables]).distinct()


def with_untracked(delta: DataFrame, untracked: DataFrame) -> DataFrame:
    """One row: added, deleted of a delta plus all lines of untracked(path, lines)."""
    more = untracked.agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("more"))
    return delta.crossJoin(F.broadcast(more)).select((F.col("added") + F.col("more")).alias("added"), "deleted")


def commits_since(commits: DataFrame, refs: DataFrame) -> DataFrame:
    """(hash, n) of refs(hash): how many of commits(hash, ord) are newer; null for an unknown one."""
    return refs.join(commits.select("hash", F.col("ord").alias("n")), "hash", "left")


def commits_after(commits: DataFrame, times: DataFrame) -> DataFrame:
    """(at, n) of times(at): how many of commits(hash, committed) are of that time or later."""
    # Sorted together, latest first and commits before times, a time's place counts the commits wanted and the times.
    marks = times.select("at").where("at is not null").distinct()
    both = commits.select(F.col("committed").alias("at"), F.lit(0).alias("mark")).where("at is not null").unionByName(marks.withColumn("mark", F.lit(1)))
    among_all, _ = places(both, F.desc("at"), "mark")
    among_marks, _ = places(marks, F.desc("at"))
    met = among_all.where("mark = 1").select("at", F.col("place").alias("all")).join(among_marks.select("at", "place"), "at")
    return times.join(met.select("at", (F.col("all") - F.col("place")).alias("n")), "at")


def dependency_dims(manifests: DataFrame) -> DataFrame:
    """(key, value, unit) of manifests(path, text): how many packages each group of a JSON manifest has.
    A manifest that isn't JSON has no row, rather than a zero."""
    schema = "dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>, _bad string"
    rows = manifests.select("path", F.from_json("text", schema, {"columnNameOfCorruptRecord": "_bad"}).alias("m")).where("m._bad is null")
    groups = F.array(*[F.struct(F.lit(g).alias("g"), F.coalesce(F.size(F.col(f"m.{g}")), F.lit(0)).alias("n")) for g in ("dependencies", "devDependencies", "peerDependencies")])
    return rows.select("path", F.explode(groups).alias("x")).select(F.concat_ws("|", "x.g", "path").alias("key"), F.col("x.n").cast("double").alias("value"), F.lit("packages").alias("unit"))


def probe_dims(outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dims(key, value), unmeasurable(key)) of outputs(key, exit_code, stdout): the last number a probe
    printed; a failed or silent probe is unmeasurable, not zero."""
    from strata.functions.columns import last_number

    rows = outputs.select("key", F.when(F.col("exit_code") == 0, last_number(F.col("stdout"))).alias("value"))
    return rows.where("value is not null"), rows.where("value is null").select("key")


def bindings(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bindings(name, kind), conflicts(name, kinds)) of found(name, kind): a name with two kinds is a conflict."""
    by = found.groupBy("name").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    return by.where(F.size("kinds") == 1).select("name", F.get("kinds", F.lit(0)).alias("kind")), by.where(F.size("kinds") > 1)
