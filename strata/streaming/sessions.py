"""Sessions as live state: what a cold read of the ledger says of each, kept up to date row by row.

Replays (a file compacted or rewritten, a trigger repeated) are dropped by the rows' own keys, which
spreads a busy session over all tasks; what is new is summed in Arrow batches before it is shuffled, so
the state of a session gets one row for a batch of thousands. That state is a value (the summary so
far), a map (the experiments it opened and closed, in whatever order they come) and a timer that goes off
when nothing new has come for a while.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

#: A row of a ledger as this stream takes it: experiment is what an experiment-opened or -closed row speaks of.
ROWS = "session string, id string, at string, kind string, agent string, experiment string"
OPENED, CLOSED = "experiment-opened", "experiment-closed"
_DELTA = "session string, start string, last string, entries long, agent string, agent_at string, agent_id string, opened array<string>, closed array<string>"
STATE = "session string, start string, last string, entries long, agent string, open long, quiet boolean, turn long"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _delta(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each session of a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t.append_column("entry", pc.cast(pc.fill_null(pc.not_equal(t["kind"], "session"), True), pa.int64()))
        for name, kind in (("opened", OPENED), ("closed", CLOSED)):
            t = t.append_column(name, pc.if_else(pc.fill_null(pc.equal(t["kind"], kind), False), t["experiment"], pa.scalar(None, pa.string())))
        t = t.sort_by([("session", "ascending"), ("at", "ascending"), ("id", "ascending")])
        g = t.group_by("session", use_threads=False).aggregate([("at", "min"), ("at", "max"), ("entry", "sum"), ("agent", "last"), ("at", "last"), ("id", "last"), ("opened", "list"), ("closed", "list")])
        g = g.select(["session", "at_min", "at_max", "entry_sum", "agent_last", "at_last", "id_last", "opened_list", "closed_list"])
        yield from g.rename_columns(_names(_DELTA)).combine_chunks().to_batches()


class SessionState(StatefulProcessor):
    def __init__(self, quiet_ms: int | None) -> None:
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.summary = handle.getValueState("summary", "start string, last string, entries long, agent string, agent_at string, agent_id string, open long, turn long, due long")
        self.experiments = handle.getMapState("experiments", "experiment string", "opened boolean, closed boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s = self.summary.get() if self.summary.exists() else (None, None, 0, None, None, None, 0, 0, 0)
        start, last, entries, agent, agent_at, agent_id, open_, turn, due = s
        for frame in rows:
            for r in frame.itertuples(index=False):
                start, last, entries = min(start or r.start, r.start), max(last or r.last, r.last), entries + int(r.entries)
                if agent_at is None or (r.agent_at, r.agent_id) >= (agent_at, agent_id):
                    agent, agent_at, agent_id = r.agent, r.agent_at, r.agent_id
                for names, opens in ((r.opened, True), (r.closed, False)):
                    for name in names:
                        if name is not None:
                            open_ += self._turned(name, opens)
        if self.quiet_ms is not None:
            if due:
                self.handle.deleteTimer(due)
            due = timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms
            self.handle.registerTimer(due)
        self.summary.update((start, last, entries, agent, agent_at, agent_id, open_, turn + 1, due))
        yield self._said(key, (start, last, entries, agent, open_, False, turn + 1))

    def _turned(self, name: str, opens: bool) -> int:
        """By how much an experiment's opening or closing changes the number of those that are open."""
        opened, closed = self.experiments.getValue((name,)) if self.experiments.containsKey((name,)) else (False, False)
        now = (True, closed) if opens else (opened, True)
        self.experiments.updateValue((name,), now)
        return (now == (True, False)) - ((opened, closed) == (True, False))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start, last, entries, agent, agent_at, agent_id, open_, turn, _ = self.summary.get()
        self.summary.update((start, last, entries, agent, agent_at, agent_id, open_, turn + 1, 0))
        yield self._said(key, (start, last, entries, agent, open_, True, turn + 1))

    @staticmethod
    def _said(key, rest: tuple) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *rest)], columns=_names(STATE))

    def close(self) -> None:
        pass


def live_sessions(rows: DataFrame, quiet_seconds: float | None = None) -> DataFrame:
    """A stream of STATE rows from a stream of ROWS: each session anew whenever something new is in it and, if
    quiet_seconds is given, when nothing has come for so long (by the clock; such a stream never runs out
    of work); the one with the highest turn counts. Rows without session, id or time play no part."""
    good = rows.where("session is not null and id is not null and at is not null").select(*_names(ROWS))
    new = good.dropDuplicates(["session", "id", "at"]).mapInArrow(_delta, _DELTA)
    timed = quiet_seconds is not None
    state = SessionState(int(1000 * quiet_seconds) if timed else None)
    return new.groupBy("session").transformWithStateInPandas(state, STATE, "Append", "ProcessingTime" if timed else "None")


def latest(states: DataFrame) -> DataFrame:
    """The newest of each session's STATE rows."""
    return states.groupBy("session").agg(F.max_by(F.struct(*_names(STATE)), "turn").alias("s")).select("s.*")


def settled(rows: DataFrame) -> DataFrame:
    """(session, start, last, entries, agent, open) of a table of ROWS: what the stream comes to."""
    one = rows.where("session is not null and id is not null and at is not null").dropDuplicates(["session", "id", "at"])
    of = lambda kind: F.array_compact(F.collect_set(F.when(F.col("kind") == kind, F.col("experiment"))))
    by = one.groupBy("session").agg(
        F.min("at").alias("start"), F.max("at").alias("last"), F.count_if(F.coalesce(F.col("kind") != "session", F.lit(True))).alias("entries"),
        F.max_by("agent", F.struct("at", "id")).alias("agent"), F.size(F.array_except(of(OPENED), of(CLOSED))).cast("long").alias("open"),
    )
    return by


def start(states: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes the states as Parquet under `out`, each exactly once. Maps, values and timers need the state store that RocksDB backs."""
    spark, name = states.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        writer = states.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
        return (writer.trigger(**trigger) if trigger else writer).start()
    finally:
        spark.conf.set(name, before)
