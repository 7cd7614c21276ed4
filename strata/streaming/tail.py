"""A stream over a folder of JSON-lines files that writers append to and compact.

Spark's own file stream takes a file as finished when it sees it first. Here an offset is, for
each file, the length up to its last line feed and a digest of all bytes before it: a trigger takes
the prefix as read only while it is, byte for byte, what was read. New lines are what follows the
prefix; a file whose prefix has changed anywhere is read again from its start; a line without its
line feed waits; a deleted file is forgotten. Files that the file system says nobody wrote to since the
last trigger aren't opened, and one that was is read once, however many prefixes of it are asked for.
The folder must be one that the driver and the executors share.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class Span(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


_CHUNK = 1 << 20


class Prefixes:
    """Digests of files up to a length, kept while the file's number, size and times of change stay."""

    def __init__(self) -> None:
        self._known: dict[str, tuple[tuple, dict[int, str], int]] = {}

    def read(self, path: str, *lengths: int) -> tuple[int, dict[int, str]]:
        """(bytes up to the last line feed, digests by length) of a file, for that length and those asked
        for; no digest for a length that the file doesn't have."""
        with open(path, "rb") as f:
            stat = os.fstat(f.fileno())
            mark = (stat.st_ino, stat.st_size, stat.st_mtime_ns, stat.st_ctime_ns)
            known = self._known.get(path)
            if known is None or known[0] != mark or not set(lengths) <= {*known[1], *(n for n in lengths if n > stat.st_size)}:
                whole = _whole_lines(f, stat.st_size)
                wanted = sorted({whole, *(n for n in lengths if n <= stat.st_size), *(known[1] if known and known[0] == mark else ())})
                digests, h, at = {}, hashlib.sha256(), 0
                f.seek(0)
                for n in wanted:
                    while at < n and (data := f.read(min(_CHUNK, n - at))):
                        h.update(data)
                        at += len(data)
                    digests[n] = h.hexdigest()
                known = self._known[path] = (mark, digests, whole)
            return known[2], known[1]

    def forget(self, but: set[str]) -> None:
        self._known = {p: k for p, k in self._known.items() if p in but}


def _whole_lines(f, end: int) -> int:
    """Bytes up to the last line feed, found from the end."""
    while end:
        start = max(0, end - _CHUNK)
        f.seek(start)
        at = f.read(end - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        end = start
    return 0


class TailReader(DataSourceStreamReader):
    def __init__(self, root: str, suffix: str) -> None:
        self.root, self.suffix, self.prefixes = root, suffix, Prefixes()
        self._last: dict[str, int] = {}  # the lengths that the next trigger will ask about

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        now = {}
        for folder, _, names in os.walk(self.root):
            for name in sorted(names):
                if name.endswith(self.suffix):
                    path = os.path.join(folder, name)
                    try:
                        n, digests = self.prefixes.read(path, *([self._last[path]] if path in self._last else []))
                    except FileNotFoundError:
                        continue
                    if n:
                        now[os.path.relpath(path, self.root)] = [n, digests[n]]
        self._last = {os.path.join(self.root, name): n for name, (n, _) in now.items()}
        self.prefixes.forget(set(self._last))
        return {"files": json.dumps(now, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        before, now = json.loads(start["files"]), json.loads(end["files"])
        out = []
        for name, (n, _) in now.items():
            path = os.path.join(self.root, name)
            old, seen = before.get(name, [0, ""])
            try:
                same = 0 < old <= n and self.prefixes.read(path, old)[1].get(old) == seen
            except FileNotFoundError:
                continue
            at = old if same else 0
            if at < n:
                out.append(Span(path, at, n))
        return out

    def read(self, partition: Span) -> Iterator[tuple]:
        try:
            with open(partition.path, "rb") as f:
                f.seek(partition.start)
                data = f.read(partition.end - partition.start)
        except FileNotFoundError:  # compacted meanwhile; its lines are in another file
            return
        for line in data.decode("utf-8", "replace").split("\n"):
            if line:
                yield (os.path.relpath(partition.path, self.root), line)

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strata-tail"

    def schema(self) -> str:
        return "file string, value string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], self.options.get("suffix", ".jsonl"))


def rows_of(spark: SparkSession, path: str, schema: str, suffix: str = ".jsonl") -> DataFrame:
    """A stream of (file, the fields of the schema) of the rows under path; those of a file that is read again
    come again. A line that isn't such an object has only nulls."""
    spark.dataSource.register(TailSource)
    rows = spark.readStream.format("strata-tail").option("path", path).option("suffix", suffix).load()
    return rows.select("file", F.from_json("value", schema).alias("r")).select("file", "r.*")


def tail(spark: SparkSession, path: str, schema: str, *, keys: tuple[str, ...] = ("session", "id", "at"), watermark: tuple[str, str] | None = None) -> DataFrame:
    """A stream of the rows under path, each once by its keys.

    What is remembered of the keys grows with the ledger. With watermark (column, delay) it is
    bounded, and a duplicate that comes later than the delay passes.
    """
    good = rows_of(spark, path, schema).where(F.coalesce(*[F.col(k).isNull() for k in keys], F.lit(False)) == F.lit(False))
    if watermark:
        column, delay = watermark
        return good.withColumn("_t", F.to_timestamp(column)).withWatermark("_t", delay).dropDuplicatesWithinWatermark(list(keys))
    return good.dropDuplicates(list(keys))


def project(stream: DataFrame, project_batch, checkpoint: str, trigger: dict | None = None):
    """Runs project_batch(rows so far in this batch, number) on every batch, with a restartable checkpoint."""
    writer = stream.writeStream.foreachBatch(project_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start() if trigger else writer.start()
