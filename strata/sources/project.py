"""Files, histories and reports of a project as tables."""

from __future__ import annotations

import json
import os
import re
import tomllib
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.columns import is_test_path
from strata.operators.globs import first_match
from strata.sources.shared import dealt, materialize, partitions


@dataclass(frozen=True)
class Config:
    """Settings over defaults. declared is False where the file is absent."""

    root: str
    sources: str = "src"
    extensions: tuple = (".py", ".ts", ".js")
    ignore: tuple = ("node_modules", ".git", "dist", "build")
    entry: str = "project.spec.md"
    overrides: tuple = ()
    tolerance: dict = field(default_factory=dict)
    declared: bool = False


def load_config(root: str, name: str = "strata.json") -> Config:
    """The settings of a project; an unreadable file is refused, never defaulted over."""
    path = os.path.join(root, name)
    if not os.path.exists(path):
        return Config(root)
    with open(path, encoding="utf-8") as f:
        try:
            given = json.load(f)
        except ValueError as e:
            raise ValueError(f"{name} can't be read: {e}") from e
    unknown = set(given) - set(Config.__dataclass_fields__)
    if unknown:
        raise ValueError(f"{name} has unknown settings: {', '.join(sorted(unknown))}")
    return Config(root, **{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()}, declared=True)


#: Bytes of files that one batch of a task holds, beyond a single file.
_HELD = 16 << 20


def _listed(spark: SparkSession, root: str, hidden: str) -> DataFrame:
    """(path,) of the files with a byte under a folder that all machines mount. Each round lists the folders that the
    one before found, in tasks; what is hidden isn't entered."""

    def entries(batches):
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = []
                with os.scandir(os.path.join(root, folder)) as there:
                    for e in there:
                        path = f"{folder}/{e.name}" if folder else e.name
                        try:
                            is_dir = e.is_dir()
                            kept = is_dir or e.stat().st_size > 0
                        except FileNotFoundError:
                            continue
                        if kept and not (e.name.startswith("_") and "=" not in e.name) and not re.search(hidden, path):
                            found.append((path, is_dir))
                        if len(found) == 10_000:
                            yield _rows(found)
                            found = []
                yield _rows(found)

    todo, levels = spark.createDataFrame([("",)], "path string"), []
    while True:
        level = materialize(todo.mapInArrow(entries, "path string, folder boolean"), "listed")
        levels.append(level.where("not folder").select("path"))
        todo = level.where("folder").select("path")
        if (n := todo.count()) == 0:
            return reduce(DataFrame.unionByName, levels)
        todo = todo.repartition(min(n, 4 * partitions(todo)), "path")


def _rows(found: list[tuple[str, bool]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([d for _, d in found], pa.bool_())], ["path", "folder"])


def scan(spark: SparkSession, root: str, *, extensions: tuple[str, ...] = (), ignore: tuple[str, ...] = ()) -> DataFrame:
    """(path, content): files under root by relative path, without dot files and ignored folders.
    The scan leaves out files without a byte, and names that begin with an underscore, as Spark's readers do.

    Spark's reader lists every file on the driver and makes a task of every 32 small ones, so it only reads stores that
    aren't mounted; files of mounted ones are listed and read in tasks.
    """
    hidden = r"(^|/)(\.[^/]+" + "".join(f"|{re.escape(x)}" for x in ignore) + r")(/|$)"
    fits = F.lower("path").rlike("(" + "|".join(re.escape(x) for x in extensions) + ")$") if extensions else F.lit(True)
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    if not re.match("file:/", root if re.match(r"\w+:", root) else default):
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        path = F.substring_index("path", root.rstrip("/") + "/", -1)
        return rows.select(path.alias("path"), "content").where(~F.col("path").rlike(hidden)).where(fits)
    at = re.sub("^file:/+", "/", root)

    def read(batches):
        for batch in batches:
            paths, held, size = [], [], 0
            for path in batch.column(0).to_pylist():
                with open(os.path.join(at, path), "rb") as f:
                    held.append(f.read())
                paths.append(path)
                size += len(held[-1])
                if size > _HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(held, pa.binary())], ["path", "content"])
                    paths, held, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(held, pa.binary())], ["path", "content"])

    found = _listed(spark, at, hidden).where(fits)
    return dealt(found, 4 * found.count(), "path").mapInArrow(read, "path string, content binary")


def file_stats(scanned: DataFrame) -> DataFrame:
    """(path, lines, hash): line feeds (none in a binary file) and the SHA-1 of the bytes."""
    text = F.decode("content", "ISO-8859-1")
    n = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return scanned.select("path", F.when(F.contains(text, F.lit("\0")), 0).otherwise(n).cast("long").alias("lines"), F.sha1("content").alias("hash"))


def spec_dirs(scanned: DataFrame) -> DataFrame:
    """(dir, spec): folders with a spec, and the first by name."""
    rows = scanned.where(F.col("path").rlike(r"\.spec\.md$")).select(F.regexp_extract("path", "^(.*?)/?[^/]*$", 1).alias("dir"), "path")
    return rows.groupBy("dir").agg(F.min("path").alias("spec"))


def sources(scanned: DataFrame) -> DataFrame:
    """(path, text, test)."""
    return scanned.select("path", F.decode("content", "UTF-8").alias("text"), is_test_path(F.col("path")).alias("test"))


def commit_log(spark: SparkSession, path: str, limit: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(commits(hash, subject, ord), commit_files(hash, path)) from an exported log, newest first;
    of a log in several files those that sort first by name are the newest.

    A record starts with 1E, its head is hash 1F subject, then one path on each line.
    """
    # Files, and splits of a file, may be dealt in any order; their names and where each begins are part of the order.
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"))
    rows = spark.read.option("lineSep", "\x1e").text(path).select(place.alias("ord"), "value").where("trim(value) <> ''").select("ord", F.split("value", "\n").alias("ls"))
    rows = rows.orderBy("ord").limit(limit)
    head = F.split(F.get("ls", F.lit(0)), "\x1f")
    paths = F.array_remove(F.slice("ls", F.lit(2), F.greatest(F.size("ls") - 1, F.lit(0))), "")
    rows = rows.select(F.get(head, F.lit(0)).alias("hash"), F.get(head, F.lit(1)).alias("subject"), "ord", paths.alias("paths"))
    return rows.select("hash", "subject", "ord"), rows.select("hash", F.explode("paths").alias("path"))


def commit_deltas(spark: SparkSession, path: str) -> DataFrame:
    """(hash, added, deleted) from an exported log with one short statistic for each commit."""
    n = lambda word: F.coalesce(F.regexp_extract("value", rf"(\d+) {word}", 1).try_cast("long") if hasattr(Column, "try_cast") else F.expr(f"try_cast(regexp_extract(value, '([0-9]+) {word}', 1) as bigint)"), F.lit(0))
    rows = spark.read.option("lineSep", "\x1e").text(path).where("trim(value) <> ''")
    return rows.select(F.trim(F.substring_index("value", "\n", 1)).alias("hash"), n("insertion").alias("added"), n("deletion").alias("deleted"))


def rebase(commit_files: DataFrame, prefix: str) -> DataFrame:
    """Only paths under the prefix, without it."""
    return commit_files.where(F.col("path").startswith(prefix)).withColumn("path", F.substring("path", len(prefix) + 1, 1 << 30)) if prefix else commit_files


def component_of(files: DataFrame, overrides: list[tuple[str, str]]) -> DataFrame:
    """files(path, component) with the component of the first override (glob, component) that fits."""
    first = first_match(files, [g for g, _ in overrides])
    named = files.sparkSession.createDataFrame([(i, name) for i, (_, name) in enumerate(overrides)], "number int, _name string")
    by = first.join(named, "number").select("path", "_name")
    return files.join(by, "path", "left").withColumn("component", F.coalesce("_name", "component")).select(*files.columns)


def loc_delta(numstat: DataFrame, extensions: tuple[str, ...], ignore: tuple[str, ...]) -> DataFrame:
    """One row: added, deleted over numstat(path, added, deleted) of code outside ignored folders."""
    rows = numstat.where(F.col("path").rlike("(" + "|".join(re.escape(x) for x in extensions) + ")$"))
    if ignore:
        rows = rows.where(~F.col("path").rlike("(^|/)(" + "|".join(re.escape(x) for x in ignore) + ")/"))
    return rows.agg(F.coalesce(F.sum("added"), F.lit(0)).alias("added"), F.coalesce(F.sum("deleted"), F.lit(0)).alias("deleted"))


def json_objects(text: str | None) -> list[str]:
    """Top-level {…} of a noisy text; braces inside strings don't count."""
    out, depth, start, quoted, skip = [], 0, 0, False, False
    for i, c in enumerate(text or ""):
        if skip:
            skip = False
        elif depth and quoted:
            quoted, skip = c != '"', c == "\\"
        elif c == '"' and depth:
            quoted = True
        elif c == "{":
            start, depth = (i, 1) if not depth else (start, depth + 1)
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                out.append(text[start : i + 1])
    return out


def jsonc(text: str | None) -> str | None:
    """JSON from JSON with comments and trailing commas; strings are left as they are."""
    if text is None:
        return None
    token = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/|,(?=(?:\s|//[^\n]*|/\*.*?\*/)*[}\]])', re.S)
    return token.sub(lambda m: m[0] if m[0][0] == '"' else "", text)


def toml_json(text: str | None) -> str | None:
    try:
        return None if text is None else json.dumps(tomllib.loads(text), default=str)
    except tomllib.TOMLDecodeError:
        return None


def canonical_json(text: str | None) -> str | None:
    """The same value with sorted keys and no spaces; null for what isn't JSON."""
    try:
        return None if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except ValueError:
        return None


def python_column(f, kind: str, text: Column) -> Column:
    """f over a text column, in Arrow batches: for what no built-in function can say."""
    return F.udf(f, kind, useArrow=True)(text)


_VITEST = "testResults array<struct<name:string,assertionResults:array<struct<fullName:string,status:string,duration:double>>>>"
_PYTEST = "tests array<struct<nodeid:string,outcome:string,call:struct<duration:double>>>"


def test_report(outputs: DataFrame, kind: str) -> DataFrame:
    """(run, full_name, status, file, duration) of outputs(run, text): of a run's noisy output the last
    object that is such a report counts; durations are milliseconds."""
    objects = python_column(json_objects, "array<string>", F.col("text"))
    schema, key = (_VITEST, "testResults") if kind == "vitest" else (_PYTEST, "tests")
    parsed = F.transform("objects", lambda o: F.from_json(o, schema))
    last = F.try_element_at(F.filter("parsed", lambda r: r[key].isNotNull()), F.lit(-1))
    rows = outputs.withColumn("objects", objects).withColumn("parsed", parsed).where(F.exists("parsed", lambda r: r[key].isNotNull())).select("run", last.alias("r"))
    if kind == "vitest":
        t = rows.select("run", F.explode("r.testResults").alias("f")).select("run", F.col("f.name").alias("file"), F.explode("f.assertionResults").alias("a"))
        return t.select("run", F.col("a.fullName").alias("full_name"), F.col("a.status").alias("status"), "file", F.col("a.duration").alias("duration"))
    t = rows.select("run", F.explode("r.tests").alias("t"))
    return t.select("run", F.col("t.nodeid").alias("full_name"), F.col("t.outcome").alias("status"), F.substring_index("t.nodeid", "::", 1).alias("file"), (F.col("t.call.duration") * 1000).alias("duration"))


def pytest_function(nodeid: Column) -> Column:
    return F.regexp_replace(F.substring_index(nodeid, "::", -1), r"\[.*$", "")


def patch_paths(text: Column) -> Column:
    """array<struct<op, path>> of the files that a patch adds, updates, deletes or moves to."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^\*\*\* (?:(?:Add|Update|Delete) File|Move to): .+$"), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.lower(F.regexp_extract(x, r"^\*\*\* (\w+)", 1)).alias("op"), F.trim(F.regexp_replace(x, r"^\*\*\* [^:]+: ", "")).alias("path")))


def hook_reads(payload: Column) -> Column:
    """struct<session, tool, paths> of a tool event's JSON."""
    get = lambda p: F.get_json_object(payload, p)
    listed = F.array_compact(F.array(get("$.tool_input.file_path"), get("$.tool_input.path"), get("$.tool_input.notebook_path")))
    patched = F.coalesce(F.transform(patch_paths(get("$.tool_input.command")), lambda x: x["path"]), F.array().cast("array<string>"))
    return F.struct(get("$.session_id").alias("session"), get("$.tool_name").alias("tool"), F.array_distinct(F.concat(listed, patched)).alias("paths"))


def premise_referents(records: DataFrame) -> DataFrame:
    """(id, referent, kind, strong) of records(id, chose, because, files): the files a record names are
    strong; without them, paths and back-ticked symbols of its texts are weak."""
    text = F.concat_ws(" ", "chose", "because")
    named = F.col("files").isNotNull() & (F.size("files") > 0)
    paths = F.regexp_extract_all(text, F.lit(r"((?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+\.[A-Za-z]{1,5}|[A-Za-z0-9_-]+\.(?:ts|py|js|md|json))(?::\d+)?"), F.lit(1))
    symbols = F.regexp_extract_all(text, F.lit(r"`([A-Za-z_][A-Za-z0-9_.]*)(?:\(\))?`"), F.lit(1))
    row = lambda c, k, s: F.transform(c, lambda x: F.struct(x.alias("referent"), F.lit(k).alias("kind"), F.lit(s).alias("strong")))
    weak = F.concat(row(paths, "file", False), row(symbols, "symbol", False))
    return records.select("id", F.explode(F.array_distinct(F.when(named, row(F.col("files"), "file", True)).otherwise(weak))).alias("r")).select("id", "r.*")


def premise_leases(referents: DataFrame, paths: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, status): the worst of a record's referents: live, moved (another path has its name) or missing."""
    last = lambda c: F.lower(F.substring_index(c, "/", -1))
    have = paths.select(F.col("path").alias("referent")).distinct().withColumn("exact", F.lit(True))
    names = paths.select(last("path").alias("name")).distinct().withColumn("near", F.lit(True))
    known = symbols.select(F.col("symbol").alias("referent")).distinct().withColumn("defined", F.lit(True))
    rows = referents.join(have, "referent", "left").withColumn("name", last("referent")).join(names, "name", "left").join(known, "referent", "left")
    live = F.when(F.col("kind") == "file", F.col("exact")).otherwise(F.col("defined"))
    worst = F.when(F.coalesce(live, F.lit(False)), 0).when((F.col("kind") == "file") & F.coalesce("near", F.lit(False)), 1).otherwise(2)
    return rows.groupBy("id").agg(F.max(worst).alias("w")).select("id", F.element_at(F.array(F.lit("live"), F.lit("moved"), F.lit("missing")), F.col("w") + 1).alias("status"))
