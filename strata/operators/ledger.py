"""Append-only ledgers: deduplication, supersession, positions, priors, bands and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The last row of each key; a row whose key has a null stays as it is."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(o) if isinstance(o, str) else o for o in order])
    kept = rows.where(whole).withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r")
    return kept.unionByName(rows.where(~whole))


def timeline(rows: DataFrame) -> DataFrame:
    return rows.orderBy("at", "id", "session")


def in_scope(rows: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows equal to each wanted value that is given (job, agent, session, branch)."""
    for name, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows


def activity_counts(rows: DataFrame) -> DataFrame:
    """(event, n) of activity(replay_key, event, at, ord): a replayed event counts once."""
    return last_wins(rows, ["replay_key"], "ord").groupBy("event").agg(F.count("*").alias("n"))


def command_counts(rows: DataFrame) -> DataFrame:
    """(kind, total, success, failure, unknown) of rows(kind, result)."""
    n = lambda x: F.count_if(F.col("result") == x)
    return rows.groupBy("kind").agg(F.count("*").alias("total"), n("success").alias("success"), n("failure").alias("failure"), F.count_if(~F.col("result").isin("success", "failure") | F.col("result").isNull()).alias("unknown"))


def sessions(records: DataFrame) -> DataFrame:
    """(session, start, last, entries, agent): headers don't count as entries; the agent is the latest."""
    return records.groupBy("session").agg(
        F.min("at").alias("start"), F.max("at").alias("last"), F.count_if(F.col("kind") != "session").alias("entries"),
        F.max_by("agent", F.struct("at", "id")).alias("agent"),
    )


def resolve(records: DataFrame) -> DataFrame:
    """records(id, kind, supersedes, at, ord, …) plus state and by: standing, blocked, open,
    resolved, dismissed or retracted, and the id of the row that made it so.

    Identity is content: of rows with one id the last counts, session headers don't. A retraction
    takes a row out, also one that itself answered another; a resolution outranks a dismissal.
    Rows that only act on others have a state of their own only if they were retracted.
    """
    rows = last_wins(records.where("kind <> 'session'"), ["id"], "ord")
    acting = rows.where("supersedes is not null").select(F.col("id").alias("by"), F.col("supersedes").alias("id"), "kind", "ord")
    latest = lambda kind, name: acting.where(F.col("kind") == kind).groupBy("id").agg(F.max_by("by", "ord").alias(name))
    withdrawn = latest("retraction", "retraction")
    alive = acting.join(withdrawn.select(F.col("id").alias("by")), "by", "left_anti")
    answer = lambda kind, name: alive.where(F.col("kind") == kind).groupBy("id").agg(F.max_by("by", "ord").alias(name))
    out = rows
    for side in (withdrawn, answer("resolution", "resolution"), answer("dismissal", "dismissal")):
        out = out.join(side, "id", "left")
    guess = F.col("kind") == "conjecture"
    state = (
        F.when(F.col("retraction").isNotNull(), "retracted")
        .when(F.col("kind").isin("retraction", "resolution", "dismissal"), None)
        .when(guess & F.col("resolution").isNotNull(), "resolved")
        .when(guess & F.col("dismissal").isNotNull(), "dismissed")
        .when(guess, "open")
        .when(F.col("kind") == "blocked", "blocked")
        .otherwise("standing")
    )
    by = F.when(F.col("state") == "retracted", F.col("retraction")).when(F.col("state") == "resolved", F.col("resolution")).when(F.col("state") == "dismissed", F.col("dismissal"))
    return out.withColumn("state", state).where("state is not null").withColumn("by", by).drop("retraction", "resolution", "dismissal")


#: What a choice needs behind it, and its rank.
AUTHORITY = (("local-proposal", 1), ("orchestrator-accepted", 2), ("user-directed", 3))


def positions(standing: DataFrame) -> DataFrame:
    """(subject, state, choices, selected) from standing(id, at, subject, chose, authority).

    One choice: aligned. Else the highest authority decides if it is above a proposal and of one
    mind (ratified), or not (contested); without such authority it needs ratification. Selected is
    the id of the latest record of an aligned or ratified position.
    """
    rank = F.coalesce(F.create_map(*[F.lit(x) for pair in AUTHORITY for x in pair])[F.col("authority")], F.lit(0))
    rows = standing.where("subject is not null").withColumn("rank", rank)
    top = rows.groupBy("subject").agg(F.max("rank").alias("top"))
    both = rows.join(top, "subject")
    lead = (F.col("rank") == F.col("top")) & (F.col("rank") > 0)
    out = both.groupBy("subject", "top").agg(
        F.array_sort(F.collect_set("chose")).alias("choices"),
        F.count_distinct(F.when(lead, F.col("chose"))).alias("leading"),
        F.max_by("id", F.struct("at", "id")).alias("latest"),
        F.max_by(F.when(lead, F.col("id")), F.when(lead, F.struct("at", "id"))).alias("leader"),
    )
    state = F.when(F.size("choices") == 1, "aligned").when((F.col("top") >= 2) & (F.col("leading") == 1), "ratified").when(F.col("top") <= 1, "needs-ratification").otherwise("contested")
    return out.withColumn("state", state).select("subject", "state", "choices", F.when(F.col("state") == "aligned", F.col("latest")).when(F.col("state") == "ratified", F.col("leader")).alias("selected"))


def outside_band(rows: DataFrame) -> DataFrame:
    """rows(value, baseline, threshold) plus outside: a move of exactly the threshold is outside;
    null where a number isn't finite."""
    finite = F.lit(True)
    for c in ("value", "baseline", "threshold"):
        x = F.col(c).cast("double")
        finite = finite & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return rows.withColumn("outside", F.when(finite, F.abs(F.col("value") - F.col("baseline")) >= F.col("threshold")))


def observe(rows: DataFrame, priors: DataFrame) -> DataFrame:
    """rows(metric, value, baseline, threshold) plus action, given priors(metric, open_id, resolved_at).

    Outside the band an open question is kept, a settled one opened again, otherwise one is
    opened; inside it an open question can be closed.
    """
    both = outside_band(rows).join(priors, "metric", "left")
    action = (
        F.when(F.col("outside").isNull(), "incomparable")
        .when(F.col("outside") & F.col("open_id").isNotNull(), "already-open")
        .when(F.col("outside") & F.col("resolved_at").isNotNull(), "reopen")
        .when(F.col("outside"), "open")
        .when(F.col("open_id").isNotNull(), "close")
        .otherwise("within")
    )
    return both.withColumn("action", action)


def priors(resolved: DataFrame) -> DataFrame:
    """(finding, open_id, settled_id): the latest open and the latest settled record of each finding
    of resolve()'s rows."""
    newest = lambda states: F.max_by(F.when(F.col("state").isin(*states), F.col("id")), F.when(F.col("state").isin(*states), F.struct("at", "id")))
    return resolved.where("finding is not null").groupBy("finding").agg(newest(["open"]).alias("open_id"), newest(["resolved", "dismissed"]).alias("settled_id"))


def raise_findings(findings: DataFrame, known: DataFrame, cap: int = 3) -> DataFrame:
    """findings(advisory, subject, ord) plus outcome: already-open, settled, raised, or withheld beyond
    `cap` fresh ones, which are taken in turn from each advisory."""
    rows = findings.withColumn("finding", F.concat_ws(":", "advisory", "subject")).join(known, "finding", "left")
    state = F.when(F.col("open_id").isNotNull(), "already-open").when(F.col("settled_id").isNotNull(), "settled").otherwise("fresh")
    rows = rows.withColumn("state", state)
    lane = Window.partitionBy("state", "advisory").orderBy("ord", "subject")
    fresh = rows.where("state = 'fresh'").withColumn("turn", F.row_number().over(lane))
    lanes = fresh.groupBy("advisory").agg(F.min("ord").alias("lane"))
    # At most `cap` rows of a lane can be among the first `cap`.
    head = fresh.where(F.col("turn") <= cap).join(lanes, "advisory").orderBy("turn", "lane", "subject").limit(cap).select("finding", F.lit(True).alias("picked"))
    out = rows.join(F.broadcast(head), "finding", "left")
    return out.withColumn("outcome", F.when(F.col("state") != "fresh", F.col("state")).when(F.col("picked"), "raised").otherwise("withheld")).select("finding", "advisory", "subject", "outcome")


def merge_claims(before: DataFrame, fresh: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Claim records (node, claim, kind, ever_failed, runs) after a run.

    A skip keeps the verdict it finds; a failure is remembered; runs counts what wasn't skipped. In scope
    (node), or everywhere without one, claims that the run doesn't have are dropped.
    """
    keys = ["node", "claim"]
    b = before.select(*keys, F.col("kind").alias("b_kind"), F.col("ever_failed").alias("b_failed"), F.col("runs").alias("b_runs"))
    f = fresh.select(*keys, F.col("kind").alias("f_kind"))
    rows = b.join(f, keys, "full_outer")
    if scope is not None:
        rows = rows.join(scope.select("node").distinct().withColumn("scoped", F.lit(True)), "node", "left")
        rows = rows.where(F.col("f_kind").isNotNull() | F.col("scoped").isNull())
    else:
        rows = rows.where("f_kind is not null")
    ran = F.col("f_kind").isNotNull() & (F.col("f_kind") != "skip")
    return rows.select(
        *keys,
        F.when(ran, F.col("f_kind")).otherwise(F.coalesce("b_kind", "f_kind")).alias("kind"),
        (F.coalesce("b_failed", F.lit(False)) | (ran & (F.col("f_kind") == "fail"))).alias("ever_failed"),
        (F.coalesce("b_runs", F.lit(0)) + ran.cast("int")).alias("runs"),
    )


def experiment_outcome(results: DataFrame) -> DataFrame:
    """(experiment, outcome): an unmet criterion fails it, all met succeed, else inconclusive."""
    return results.groupBy("experiment").agg(F.bool_or(F.col("status") == "unmet").alias("bad"), F.bool_and(F.col("status") == "met").alias("good")).select(
        "experiment", F.when(F.col("bad"), "failure").when(F.col("good"), "success").otherwise("inconclusive").alias("outcome")
    )


def totality(expected: DataFrame, supplied: DataFrame) -> DataFrame:
    """(experiment, id, damage): plan items without a result, results without an item, and repeats."""
    s = supplied.groupBy("experiment", "id").agg(F.count("*").alias("n"))
    rows = expected.select("experiment", "id", F.lit(True).alias("planned")).join(s, ["experiment", "id"], "full_outer")
    damage = F.when(F.col("planned").isNull(), "unplanned").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
    return rows.select("experiment", "id", damage.alias("damage")).where("damage is not null")


def dangling(links: DataFrame, known: DataFrame, aside: tuple[str, ...] = ("verification",)) -> DataFrame:
    """(kind, id, links): link ends that known(kind, id) doesn't have, and the links that name them.
    Kinds of `aside` aren't checked here."""
    ends = links.select(F.col("id").alias("link"), F.explode(F.array("from", "to")).alias("ref")).select("link", "ref.kind", "ref.id").where(~F.col("kind").isin(*aside))
    return ends.join(known, ["kind", "id"], "left_anti").groupBy("kind", "id").agg(F.array_sort(F.collect_set("link")).alias("links"))


def trace(links: DataFrame, kind: str, ident: str) -> DataFrame:
    """Links that begin or end at a ref."""
    at = lambda c: (F.col(f"{c}.kind") == kind) & (F.col(f"{c}.id") == ident)
    return links.where(at("from") | at("to"))
