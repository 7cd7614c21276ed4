"""Running counts over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_counts(events: DataFrame, *, event: str = "event", replay_key: str = "replay_key") -> DataFrame:
    """(event, n) of a stream; a replayed event counts once, one without a key each time.

    The key and what tells keyless rows apart are the state that deduplication keeps.
    """
    told_apart = F.coalesce(F.col(replay_key), F.concat(F.lit("row "), F.col("row")))
    return events.withColumn("_once", told_apart).dropDuplicates(["_once"]).groupBy(F.col(event).alias("event")).agg(F.count("*").alias("n"))


def windowed_counts(events: DataFrame, *, at: str = "ts", event: str = "event_type", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event, n, total) by event time; rows later than `late` behind the newest are left out."""
    rows = events.withWatermark(at, late)
    return rows.groupBy(F.window(at, size), F.col(event).alias("event")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event", "n", "total")
