"""A ledger that several writers may append to at once, with nothing lost, half written or twice there.

    <path>/rows/<name>.jsonl     what tasks wrote; counts only once a generation names it
    <path>/log/<number>.json     a generation: the files of one append, and which keys it touched

Tasks stage their rows in files of their own. The commit creates the file of the next generation, which
the file system grants to one writer only; until then no reader sees a row. A writer that finds its
number taken looks at which keys the other one wrote: if it neither wrote nor read any of them, the
order of the two doesn't matter and it takes the next number, otherwise the append is refused and made
again from what is there now. So what a row was decided upon (that its id was new, that its
predecessor was the last) still holds when it becomes visible. Failed and repeated tasks leave files that
no generation names.

The folder must be mounted by the driver and all executors, and its file system must create hard links.
"""

from __future__ import annotations

import contextlib
import json
import os
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Keys are told apart by their bucket of so many: two appends to different buckets never disturb each other.
BUCKETS = 4096
_REFUSED = "ledger moved on"
_STAGED = "bucket int, reads array<int>, value string"
_GENERATION = "number long, txn string, files array<struct<name: string, rows: long>>"


class Refused(Exception):
    """Another writer touched the same keys meanwhile."""


def local(path: str) -> str:
    """A file: address as a path."""
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def head(path: str) -> int:
    """The number of the last generation; 0 if there is none."""
    try:
        return max((int(x[:-5]) for x in os.listdir(f"{local(path)}/log") if x.endswith(".json") and x[:-5].isdigit()), default=0)
    except FileNotFoundError:
        return 0


def _generation(path: str, number: int) -> dict:
    with open(f"{path}/log/{number:020d}.json", encoding="utf-8") as f:
        return json.load(f)


def _create(path: str, text: str) -> bool:
    """Whether this call made the file: whole at once, or not at all if there is one of that name."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    fd, made = tempfile.mkstemp(prefix=".", dir=os.path.dirname(path))
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.link(made, path)
        return True
    except FileExistsError:
        return False
    finally:
        os.unlink(made)


@dataclass
class Staged(WriterCommitMessage):
    """What one task wrote: its file, if it had rows, and the buckets of the keys it wrote and read."""

    files: list[tuple[str, int]] = field(default_factory=list)
    wrote: set[int] = field(default_factory=set)
    read: set[int] = field(default_factory=set)


def _stage(path: str, batches: Iterator[pa.RecordBatch]) -> Staged:
    out, rows, f = Staged(), 0, None
    name = f"{uuid.uuid4().hex}.jsonl"
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            if f is None:
                os.makedirs(f"{path}/rows", exist_ok=True)
                f = open(f"{path}/rows/.{name}", "w", encoding="utf-8", newline="\n")
            f.writelines(x + "\n" for x in batch.column("value").to_pylist())
            rows += batch.num_rows
            out.wrote |= set(batch.column("bucket").unique().to_pylist())
            out.read |= set(batch.column("reads").flatten().unique().to_pylist())
        if f is not None:
            f.flush()
            os.fsync(f.fileno())
    finally:
        if f is not None:
            f.close()
    if f is not None:
        os.rename(f"{path}/rows/.{name}", f"{path}/rows/{name}")
        out.files.append((name, rows))
    return out


def _commit(path: str, messages: list[Staged | None], txn: str, seen: int, *, since: int | None = None, guarded: bool = True) -> None:
    """Names the staged files in one generation after `seen`, the last that the rows were decided upon;
    if guarded, none between may have touched their keys. Nothing happens if a generation after `since`
    (`seen` unless given) is of the same txn: then this is a repeated commit."""
    staged = [m for m in messages if m is not None]
    files = sorted(f for m in staged for f in m.files)
    wrote = set().union(*(m.wrote for m in staged))
    touched = wrote | set().union(*(m.read for m in staged))
    last = head(path)
    for number in range((seen if since is None else since) + 1, last + 1):
        if _generation(path, number)["txn"] == txn:
            return
    if not files:
        return
    number = seen + 1
    while True:
        record = {"number": number, "txn": txn, "files": [{"name": n, "rows": r} for n, r in files], "wrote": sorted(wrote)}
        if number > last and _create(f"{path}/log/{number:020d}.json", json.dumps(record)):
            return
        other = _generation(path, number)
        if other["txn"] == txn:
            return
        if guarded and touched & set(other["wrote"]):
            raise Refused(f"{_REFUSED}: generation {number} of {path} has rows with the same keys")
        number += 1


def _discard(path: str, messages: list[Staged | None]) -> None:
    for m in messages:
        for name, _ in m.files if m is not None else ():
            with contextlib.suppress(FileNotFoundError):
                os.unlink(f"{path}/rows/{name}")


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.txn, self.seen = local(options["path"]), options.get("txn", uuid.uuid4().hex), int(options["seen"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        return _stage(self.path, iterator)

    def commit(self, messages: list[Staged | None]) -> None:
        try:
            _commit(self.path, messages, self.txn, self.seen)
        except Refused:
            _discard(self.path, messages)
            raise

    def abort(self, messages: list[Staged | None]) -> None:
        _discard(self.path, messages)


class _StreamWriter(DataSourceStreamArrowWriter):
    """Each batch of a stream once: the name of the stream and the number of the batch are its transaction.
    The last generation that a batch of this stream made is noted, so a restart looks no further back."""

    def __init__(self, options: dict) -> None:
        self.path, self.name = local(options["path"]), options["txn"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        return _stage(self.path, iterator)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        notes = f"{self.path}/streams/{self.name}"
        os.makedirs(notes, exist_ok=True)
        last, since = max((tuple(map(int, x.split("-"))) for x in os.listdir(notes) if not x.startswith(".")), default=(-1, 0))
        if batchId <= last:
            return _discard(self.path, messages)
        # Rows of a stream are decided upon nothing that is in the ledger: any next number will do.
        _commit(self.path, messages, f"{self.name}:{batchId}", head(self.path), since=since, guarded=False)
        _create(f"{notes}/{batchId:020d}-{head(self.path):020d}", "")

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        _discard(self.path, messages)


class LedgerSink(DataSource):
    """Takes rows of (bucket, reads, value): see staged()."""

    @classmethod
    def name(cls) -> str:
        return "strata-ledger"

    def schema(self) -> str:
        return _STAGED

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("a ledger is only appended to")
        return _Writer(self.options)

    def streamWriter(self, schema, overwrite: bool) -> _StreamWriter:
        return _StreamWriter(self.options)


_one_at_a_time = threading.Lock()


def _register(spark: SparkSession) -> None:
    """Makes the sink known; sources are looked up in the session that is the calling thread's own, which
    creating a table makes it."""
    with _one_at_a_time:
        spark.createDataFrame([], "none int")
        spark.dataSource.register(LedgerSink)


def staged(rows: DataFrame, key: str, reads: Column | None = None) -> DataFrame:
    """rows as the sink takes them: the bucket of each key, those of the keys that it was decided upon
    (an array; null for none), and the row as one line of JSON."""
    bucket = lambda c: F.pmod(F.xxhash64(c.cast("string")), F.lit(BUCKETS)).cast("int")
    also = F.array().cast("array<int>") if reads is None else F.coalesce(F.transform(F.array_compact(reads), bucket), F.array().cast("array<int>"))
    return rows.select(bucket(F.col(key)).alias("bucket"), also.alias("reads"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}).alias("value"))


def generations(spark: SparkSession, path: str) -> DataFrame:
    """(number, txn, files) of the log."""
    os.makedirs(f"{local(path)}/log", exist_ok=True)
    return spark.read.schema(_GENERATION).json(f"file://{local(path)}/log")


def snapshot(spark: SparkSession, path: str, schema: str | StructType, number: int | None = None) -> DataFrame:
    """The rows of all generations up to a number, or up to now: what is staged or was given up isn't seen."""
    number = head(path) if number is None else number
    os.makedirs(f"{local(path)}/rows", exist_ok=True)
    named = generations(spark, path).where(F.col("number") <= number).select(F.explode("files").alias("f")).select(F.col("f.name").alias("_name"))
    rows = spark.read.schema(schema).json(f"file://{local(path)}/rows").withColumn("_name", F.col("_metadata.file_name"))
    return rows.join(named, "_name", "left_semi").drop("_name")


def change(spark: SparkSession, path: str, schema: str | StructType, key: str, decide: Callable[[DataFrame], DataFrame], *, reads: Column | None = None, tries: int = 32) -> int:
    """Appends the rows that decide(rows so far) returns, all of them or none; the number of the last
    generation they were decided upon. If others wrote the same keys meanwhile, it is decided again.

    `reads` are the keys that a row depends on besides its own. What depends on rows that it doesn't name,
    such as a count of all, isn't guarded.
    """
    _register(spark)
    txn = uuid.uuid4().hex
    for turn in range(tries):
        seen = head(path)
        rows = staged(decide(snapshot(spark, path, schema, seen)), key, reads)
        try:
            rows.write.format("strata-ledger").mode("append").option("path", path).option("seen", seen).option("txn", txn).save()
            return seen
        except PySparkException as e:
            if _REFUSED not in str(e):
                raise
            time.sleep(min(2.0, 0.05 * 2**turn) * (0.5 + int(txn[:4], 16) / 0x10000))
    raise Refused(f"{_REFUSED} {tries} times in a row at {path}")


def append_once(spark: SparkSession, rows: DataFrame, path: str, key: str = "id") -> int:
    """Adds the rows whose key isn't in the ledger, of several with one key the least. However many
    writers do so at once, and however often, a key is there once. Rows with a null key stay out."""
    one = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rows.columns)).alias("r")).select("r.*")
    return change(spark, path, rows.schema, key, lambda now: one.join(now.select(key), key, "left_anti"))


MOVES = "id string, work string, step int, state string, writer string"


def move(spark: SparkSession, path: str, moves: DataFrame, writer: str) -> int:
    """Moves works(work, before, after) to another state if they are in the one before (null: not there yet).
    Each is a row of MOVES with the next step; of two writers that start from one state one gets it."""

    def decide(now: DataFrame) -> DataFrame:
        last = now.groupBy("work").agg(F.max("step").alias("at"), F.max_by("state", "step").alias("state_"))
        met = moves.groupBy("work", "before").agg(F.min("after").alias("after")).join(last, "work", "left").where(F.col("before").eqNullSafe(F.col("state_")))
        step = F.coalesce(F.col("at") + 1, F.lit(0))
        return met.select(F.concat_ws("#", F.col("work").cast("string"), step).alias("id"), F.col("work").cast("string").alias("work"), step.cast("int").alias("step"), F.col("after").alias("state"), F.lit(writer).alias("writer"))

    # The next step's id is the key: whoever moved the same work from the same state wrote the same one.
    return change(spark, path, MOVES, "id", decide)


def append_stream(stream: DataFrame, path: str, key: str, name: str, checkpoint: str):
    """Appends a stream's rows, each batch once, also if the stream is restarted within one."""
    _register(stream.sparkSession)
    return staged(stream, key).writeStream.format("strata-ledger").option("path", path).option("txn", name).option("checkpointLocation", checkpoint)


def vacuum(path: str, older_than: float = 86_400.0) -> int:
    """Deletes what was staged longer ago than so many seconds and is in no generation; how many files."""
    path = local(path)
    known = {f["name"] for n in range(1, head(path) + 1) for f in _generation(path, n)["files"]}
    gone = 0
    for x in os.scandir(f"{path}/rows") if os.path.isdir(f"{path}/rows") else ():
        if x.name.lstrip(".").removesuffix(".crc") not in known and x.stat().st_mtime < time.time() - older_than:
            os.unlink(x.path)
            gone += 1
    return gone
