"""Queries over ledgers that several writers append to at once, made from the driver's tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from strata.plans import roles as R
from strata.sources import ledger
from strata.sources.shared import folder
from strata.streaming import sessions as S
from strata.streaming import tail


def _t(c):
    return c.cast("string")


def racing_writers(spark, d):
    """Orders appended by three writers at once, each with two thirds of them: every id is there once."""
    path, k = folder(spark, "racing"), F.col("o_orderkey")
    orders = R.table(spark, d, "orders").select(F.concat(F.lit("e-"), _t(k)).alias("id"), F.concat(F.lit("s"), _t(F.col("o_custkey") % 5)).alias("session"), F.col("o_totalprice").alias("value"), k.alias("k"))
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda w: ledger.append_once(spark, orders.where(F.col("k") % 3 != w).drop("k"), path), range(3)))
    now = ledger.snapshot(spark, path, "id string, session string, value double")
    return now.groupBy("session").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.max("value").alias("most"))


def work_moves(spark, d):
    """Orders as pieces of work: opened, claimed by two writers at once, closed by the one that got them.
    Steps, and works by how many writers hold a claim."""
    path, k = folder(spark, "moves"), F.col("o_orderkey")
    works = R.table(spark, d, "orders").select(k.alias("work"))
    to = lambda rows, before, after: rows.select("work", F.lit(before).cast("string").alias("before"), F.lit(after).alias("after"))
    ledger.move(spark, path, to(works, None, "open"), "maker")
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda w: ledger.move(spark, path, to(works.where(F.col("work") % 5 != w), "open", "active"), f"w{w}"), range(2)))
    ledger.move(spark, path, to(works.where("work % 3 = 0"), "active", "completed"), "closer")
    ledger.move(spark, path, to(works.where("work % 2 = 0"), "open", "completed"), "late")  # none is open any more
    now = ledger.snapshot(spark, path, ledger.MOVES)
    held = now.where("state = 'active'").groupBy("work").agg(F.count_distinct("writer").alias("writers"))
    return now.groupBy("state").agg(F.count("*").alias("n"), F.count_distinct("work").alias("works"), F.max("step").alias("step")).unionByName(
        held.groupBy("writers").agg(F.count("*").alias("n")).select(F.concat(F.lit("claims:"), _t(F.col("writers"))).alias("state"), "n", F.col("n").alias("works"), F.lit(None).cast("int").alias("step"))
    )


def live_sessions(spark, d):
    """Events as ledgers of the sessions of seven writers, tailed: half of them, then the rest after a restart and with a
    file folded into another. What the stream comes to for each session."""
    root, out, notes = (folder(spark, x) for x in ("tailed", "states", "notes"))
    k = F.col("event_id")
    kind = F.when(k % 11 == 0, "session").when(k % 11 < 4, S.OPENED).when(k % 11 < 6, S.CLOSED).otherwise("decision")
    experiment = F.when(kind.isin(S.OPENED, S.CLOSED), F.concat(F.lit("x"), _t(k % 50)))
    at = F.date_format(F.timestamp_seconds(F.lit(1704067200) + k), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    e = R.table(spark, d, "events").select(F.concat(F.lit("s"), _t(F.col("user_id") % 40)).alias("session"), _t(k).alias("id"), at.alias("at"), kind.alias("kind"), F.concat(F.lit("a"), _t(k % 5)).alias("agent"), experiment.alias("experiment"), (k % 7).alias("w"))
    rows = e.select("w", "id", F.to_json(F.struct("session", "id", "at", "kind", "agent", "experiment")).alias("value"))

    def write(part):
        part.select("w", "value").repartition("w").write.mode("append").partitionBy("w").option("lineSep", "\n").text(root)

    def run():
        states = S.live_sessions(tail.rows_of(spark, ledger.local(root), S.ROWS, suffix=".txt"))
        q = S.start(states, out, notes)
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    write(rows.where("id % 2 = 0"))
    run()
    write(rows.where("id % 2 = 1"))
    # Lines of one writer again, in one file: what a compaction leaves while its sources are still there.
    write(rows.where("w = 3").withColumn("w", F.lit(99)).coalesce(1))
    run()
    return S.latest(spark.read.parquet(out)).select("session", "start", "last", "entries", "agent", "open")


QUERIES = {f.__name__: f for f in (racing_writers, work_moves, live_sessions)}

SQL = {
    "racing_writers": "SELECT 's' || (o_custkey % 5) AS session, count(*) AS n, count(*) AS ids, max(o_totalprice) AS most FROM orders GROUP BY 1",
    "work_moves": """SELECT 'open' AS state, count(*) AS n, count(*) AS works, 0 AS step FROM orders UNION ALL SELECT 'active', count(*), count(*), 1 FROM orders
        UNION ALL SELECT 'completed', count(*), count(*), 2 FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'claims:1', count(*), count(*), NULL FROM orders""",
    "live_sessions": """WITH e AS (SELECT 's' || (user_id % 40) AS session, event_id AS k, strftime(to_timestamp(1704067200 + event_id) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.000Z') AS t FROM events),
        x AS (SELECT session, k % 50 AS x, bool_or(k % 11 BETWEEN 1 AND 3) AS opened, bool_or(k % 11 BETWEEN 4 AND 5) AS closed FROM e GROUP BY 1, 2)
        SELECT session, min(t) AS start, max(t) AS last, count(*) FILTER (WHERE k % 11 <> 0) AS entries, 'a' || (arg_max(k, (t, CAST(k AS VARCHAR))) % 5) AS agent,
               (SELECT count(*) FROM x WHERE x.session = e.session AND opened AND NOT closed) AS open FROM e GROUP BY session""",
}
