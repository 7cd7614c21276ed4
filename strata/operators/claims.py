"""Claims: their grammar, verdicts, grades, lights, costs and what to do next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.patterns import containing

# The forms of the claim language.
BOUNDARY = r'^boundary\s+"([^"]+)"\s+at\s+(\S+)(?:\s+crossing\s+(\S+)\s+->\s+(\S+))?(?:\s+via (test|guard)\s+"([^"]+)")?$'
PARITY = r'^parity\s+"([^"]+)"\s+over\s+(\S+)\s+between\s+(\S+)\s+and\s+(\S+)\s+via test\s+"([^"]+)"$'
PASSES = r'^passes test\s+"(.+)"$'
EXISTS = r"^(\S+)\s+exists at\s+(root|this node|every node)$"
IMPORTS = r"^(\S+)\s+imports\s+(\S+)$"
RESPONDS = r'^(\S+)\s+responds\s+(\d+)(?:\s+with\s+"(.*)")?$'
RESIDES = r"^lives in\s+(\S+)$"
CONFORMS = r"^conforms to\s+([A-Za-z][A-Za-z0-9_-]*)$"
TYPECHECKS = r"^typechecks$"

#: In the order in which they are tried.
FORMS = (
    ("typechecks", TYPECHECKS), ("exists", EXISTS), ("imports", IMPORTS), ("responds", RESPONDS), ("passes", PASSES),
    ("boundary", BOUNDARY), ("lives", RESIDES), ("parity", PARITY), ("conforms", CONFORMS),
)


def group(text: Column, regex: str, i: int) -> Column:
    """A group of a match; null where the text or the group doesn't match."""
    return F.nullif(F.regexp_extract(text, regex, i), F.lit(""))


def form(claim: Column) -> Column:
    """The name of the first form that a claim has; null for none."""
    out = F.lit(None).cast("string")
    for name, regex in reversed(FORMS):
        out = F.when(claim.rlike(regex), F.lit(name)).otherwise(out)
    return out


def boundary(claim: Column) -> Column:
    """struct<inv, chokepoint, crossing_from, crossing_to, verb, oracle>; null if it isn't one."""
    names = ("inv", "chokepoint", "crossing_from", "crossing_to", "verb", "oracle")
    return F.when(claim.rlike(BOUNDARY), F.struct(*[group(claim, BOUNDARY, i + 1).alias(n) for i, n in enumerate(names)]))


def parity(claim: Column) -> Column:
    names = ("inv", "domain", "f", "g", "oracle")
    return F.when(claim.rlike(PARITY), F.struct(*[group(claim, PARITY, i + 1).alias(n) for i, n in enumerate(names)]))


def normalized(claim: Column) -> Column:
    """The claim that records are kept under: a boundary without its crossing."""
    b = boundary(claim)
    via = F.when(b["verb"].isNotNull(), F.concat(F.lit(" via "), b["verb"], F.lit(' "'), b["oracle"], F.lit('"'))).otherwise(F.lit(""))
    short = F.concat(F.lit('boundary "'), b["inv"], F.lit('" at '), b["chokepoint"], via)
    return F.when(b["crossing_from"].isNotNull() & b["crossing_to"].isNotNull(), short).otherwise(claim)


# What a claim begins with or holds, by how much it is worth a look.
RANKED = ((3, r'\svia\s+(test|guard)\s+"|^passes test\s+"|^conforms to\s+'), (2, r'^boundary\s+"'), (0, r"^\S+\s+(exists at|imports)\b"))


def never_red_rank(claim: Column) -> Column:
    """How much a claim that never failed is worth a look."""
    out = F.lit(1)
    for rank, regex in reversed(RANKED):
        out = F.when(claim.rlike(regex), rank).otherwise(out)
    return out


def oracle_results(names: DataFrame, results: DataFrame) -> DataFrame:
    """(name, verdict, ms) of names(name) against results(full_name, status, duration): tests whose full
    name contains it. One failed: fail; none ran: none-ran; no test: vanished."""
    distinct = names.select("name").distinct()
    hits = containing(distinct, results.select(F.col("full_name").alias("text"))).withColumnRenamed("text", "full_name")
    rows = distinct.join(hits.join(results, "full_name"), "name", "left")
    by = rows.groupBy("name").agg(
        F.count("full_name").alias("n"), F.count_if(F.col("status") == "failed").alias("bad"), F.count_if(F.col("status") == "passed").alias("good"),
        F.sum("duration").alias("ms"),
    )
    verdict = F.when(F.col("n") == 0, "vanished").when(F.col("bad") > 0, "fail").when(F.col("good") == 0, "none-ran").otherwise("pass")
    return by.select("name", verdict.alias("verdict"), "ms")


def grade(verb: Column, kind: Column, commit: Column, head: Column) -> Column:
    """A to D by verb and verdict, U for a skip."""
    passed = F.coalesce(kind == "pass", F.lit(False))
    stale = F.coalesce(head != commit, F.lit(False))
    test = F.when(~passed, "D").when(stale, "B").otherwise("A")
    return F.when(kind == "skip", "U").when(verb == "test", test).when((verb == "guard") & passed, "C").otherwise("D")


def light(kind: Column, commit: Column, head: Column) -> Column:
    """none without a record; a pass at another commit is stale."""
    return F.when(kind.isNull(), "none").when((kind == "pass") & F.coalesce(head != commit, F.lit(False)), "stale").otherwise(kind)


def panel(claims: DataFrame, records: DataFrame, head: str | None) -> DataFrame:
    """(component, total, pass, fail, stale, skip, none) of claims(component, claim) and their records."""
    rows = claims.join(records.select(F.col("node").alias("component"), "claim", "kind", "commit"), ["component", "claim"], "left")
    shown = light(F.col("kind"), F.col("commit"), F.lit(head).cast("string"))
    counts = [F.count_if(F.col("light") == x).alias(x) for x in ("pass", "fail", "stale", "skip", "none")]
    return rows.withColumn("light", shown).groupBy("component").agg(F.count("*").alias("total"), *counts)


def gate_summary(gates: DataFrame) -> DataFrame:
    """(component, modal, exceptions) of gates(component, grade, failed): the commonest grade, ties to
    the better one, and how many failed or are worse."""
    order = F.create_map(*[F.lit(x) for pair in zip("ABCDU", range(5), strict=True) for x in pair])
    counts = gates.groupBy("component", "grade").agg(F.count("*").alias("n"))
    modal = counts.groupBy("component").agg(F.max_by("grade", F.struct("n", -order[F.col("grade")])).alias("modal"))
    worse = F.col("failed") | (order[F.col("grade")] > order[F.col("modal")])
    return gates.join(modal, "component").groupBy("component", "modal").agg(F.count_if(worse).alias("exceptions"))


def never_red(records: DataFrame, refuted: DataFrame, least: int = 3) -> DataFrame:
    """Records(node, claim, kind, runs, ever_failed) green for `least` runs that never failed and that
    nothing refutes (refuted: node, claim), with their rank."""
    rows = records.where((F.col("kind") == "pass") & (F.col("runs") >= least) & ~F.coalesce("ever_failed", F.lit(False)))
    return rows.join(refuted.select("node", "claim"), ["node", "claim"], "left_anti").withColumn("rank", never_red_rank(F.col("claim")))


def holding_cost(costs: DataFrame, top: int = 5, total_floor: float = 1000.0, claim_floor: float = 250.0, share: float = 0.25) -> DataFrame:
    """The dearest claims of costs(claim, ms): total_ms, whether the run is loud, and whether the claim
    is a finding (a quarter of the total, at least total_floor)."""
    whole = costs.agg(F.sum("ms").alias("total_ms"), F.max("ms").alias("most"))
    rows = costs.orderBy(F.desc("ms"), "claim").limit(top).crossJoin(F.broadcast(whole))
    loud = (F.col("total_ms") >= total_floor) | (F.col("most") >= claim_floor)
    found = F.col("ms") >= F.greatest(F.lit(total_floor), F.lit(share) * F.col("total_ms"))
    return rows.select("claim", "ms", "total_ms", loud.alias("loud"), found.alias("finding"))


def verification_state(failures: Column, commit: Column, dirty: Column, head: Column, tree_dirty: Column) -> Column:
    same = head.isNotNull() & commit.isNotNull() & (F.startswith(head, commit) | F.startswith(commit, head))
    current = F.coalesce(same & ~dirty & ~tree_dirty, F.lit(False))
    return F.when(failures.isNull(), "never").when(failures > 0, "failing").when(current, "current").otherwise("stale")


#: The first step whose count isn't 0 is the next action.
LADDER = (
    ("damaged_sources", "refuse"), ("graph_problems", "refuse"), ("conflicts", "resolve-conflict"), ("dangling", "repair-navigation"), ("blocked", "unblock"),
    ("synthesizable", "synthesize"), ("ready", "dispatch"), ("active", "continue"), ("unverified", "verify"),
)


def next_action(reading: DataFrame) -> DataFrame:
    """reading (one column of LADDER each, and verification) plus action."""
    out = F.when(F.col("verification").isin("failing", "stale"), "verify").otherwise("steady")
    for name, action in reversed(LADDER):
        out = F.when(F.coalesce(F.col(name), F.lit(0)) > 0, action).otherwise(out)
    return reading.withColumn("action", out)


#: Actions of a selection, the strongest first.
ACTIONS = ("refuse", "require-decision", "redirect", "release")


def select_action(observations: DataFrame, rules: DataFrame) -> DataFrame:
    """The one action for observations(rule, key, action): the strongest, then by the order of
    rules(rule, ord), then by key. An unknown rule or one observed in two ways refuses. Without
    observations: release."""
    rank = F.create_map(*[F.lit(x) for pair in zip(ACTIONS, range(4), strict=True) for x in pair])
    ways = observations.distinct().groupBy("rule").agg(F.count_distinct("key", "action").alias("ways"), F.min(F.struct("key", "action")).alias("o"))
    rows = ways.join(rules, "rule", "left")
    action = F.when(F.col("ord").isNull() | (F.col("ways") > 1), "refuse").otherwise(F.col("o.action"))
    picked = rows.select("rule", F.col("o.key").alias("key"), action.alias("action"), F.coalesce("ord", F.lit(-1)).alias("ord")).where("action <> 'release'")
    best = picked.agg(F.min_by(F.struct("action", "rule", "key"), F.struct(rank[F.col("action")].alias("r"), "ord", "rule", "key")).alias("b"))
    return best.select(F.coalesce("b.action", F.lit("release")).alias("action"), F.col("b.rule").alias("rule"), F.col("b.key").alias("key"))


# The rules that readings are held against.
RULES = ("canonical-lifecycle-control", "significant-growth-needs-address", "swarm-coordination-integrity", "completed-work-needs-explicit-verification")


def observe_regulation(readings: DataFrame, *keys: str) -> DataFrame:
    """(keys, rule, status) of readings(keys, control_readable, target_present, control_present, signal,
    damaged_sources, graph_problems, conflicts, unsynthesized, contested, unratified, dangling, unverified):
    satisfied, violated or unavailable. A null signal wasn't measured; a null number of damaged
    sources means that nothing was read, and of other counts none."""
    status = lambda off, bad: F.when(off, "unavailable").when(bad, "violated").otherwise("satisfied")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    blind = F.col("damaged_sources").isNull() | (F.col("damaged_sources") > 0)
    tangled = n("graph_problems") + n("conflicts") + n("unsynthesized") + n("contested") + n("unratified") + n("dangling")
    seen = (
        status(~(F.coalesce("control_readable", F.lit(False)) & F.coalesce("target_present", F.lit(False))), ~F.coalesce("control_present", F.lit(False))),
        status(F.col("signal").isNull(), F.col("signal") == "needs-decision"), status(blind, tangled > 0), status(blind, n("unverified") > 0),
    )
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), s.alias("status")) for r, s in zip(RULES, seen, strict=True)]))
    return readings.select(*keys, rows.alias("o")).select(*keys, "o.*")


def claim_crossings(claims: DataFrame) -> DataFrame:
    """The first boundary of each chokepoint of claims(ord, claim)."""
    rows = claims.withColumn("b", boundary(F.col("claim"))).where("b is not null")
    return rows.groupBy("b.chokepoint").agg(F.min_by("b", "ord").alias("b")).select("b.*")


def refutation_gaps(claims: DataFrame, refutations: DataFrame) -> DataFrame:
    """Claims(node, claim) of boundaries whose invariant no refutation(node, text) names before its colon."""
    named = refutations.select("node", F.trim(F.substring_index("text", ":", 1)).alias("inv"))
    rows = claims.withColumn("inv", boundary(F.col("claim"))["inv"]).where("inv is not null")
    return rows.join(named, ["node", "inv"], "left_anti")


def adoption(counts: DataFrame) -> DataFrame:
    """counts(declared, specs, claims, oracles) plus rung; null past the ladder."""
    rung = F.when(~F.col("declared"), "declare").when(F.col("specs") == 0, "specify").when(F.col("claims") == 0, "claim").when(F.col("oracles") == 0, "prove")
    return counts.withColumn("rung", rung)


def capped(rows: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows and, on each, how many were withheld."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).limit(n).crossJoin(F.broadcast(total)).withColumn("withheld", F.greatest(F.col("total") - F.lit(n), F.lit(0))).drop("total")


def fitting_prefix(units: DataFrame, budget: int, footer: int) -> DataFrame:
    """units(doc, ord, bytes, …) of each doc up to the longest prefix that fits the budget together
    with a footer whose length follows what is withheld: footer bytes and the digits of the count."""
    run = Window.partitionBy("doc").orderBy("ord")
    whole = Window.partitionBy("doc")
    left = F.count("*").over(whole) - F.row_number().over(run)
    tail = F.when(left > 0, F.lit(footer) + F.length(left.cast("string"))).otherwise(F.lit(0))
    rows = units.withColumns({"_n": F.row_number().over(run), "_fits": F.sum("bytes").over(run) + tail <= budget})
    return rows.withColumn("_most", F.max(F.when(F.col("_fits"), F.col("_n"))).over(whole)).where("_n <= _most").drop("_n", "_fits", "_most")


def refutation_table(claims: DataFrame, refutations: DataFrame) -> DataFrame:
    """Claims(node, claim, kind) that are boundaries, with their invariant and whether a refutation(node, text)
    names it before its colon."""
    named = refutations.select("node", F.trim(F.substring_index("text", ":", 1)).alias("inv")).distinct().withColumn("_r", F.lit(True))
    rows = claims.withColumn("b", boundary(F.col("claim"))).where("b is not null").withColumn("inv", F.col("b.inv"))
    return rows.join(named, ["node", "inv"], "left").select("node", "inv", "b.chokepoint", F.coalesce("b.oracle", F.lit("—")).alias("oracle"), F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("_r", F.lit(False)).alias("refuted"))


def gate_order(rows: DataFrame) -> list[Column]:
    """The order of gates(component, inv, grade, verdict, reliants): breaches, the weakest grades, those most rely on."""
    rank = F.array_position(F.array(*[F.lit(g) for g in "UDCBA"]), F.col("grade"))
    return [F.desc(F.col("verdict") == "fail"), rank, F.desc("reliants"), F.col("component"), F.col("inv")]


def apply_verdicts(statements: DataFrame, verdicts: DataFrame, jobs: DataFrame) -> DataFrame:
    """statements(id, status, verified_hash, drift, suggested) after verdicts(id, supported, reason, corrected):
    a supported one is ok at its job's hash, another has drifted; without jobs(id, current_hash) nothing changes."""
    v = verdicts.join(jobs, "id")
    rows = statements.join(v, "id", "left")
    yes, no = F.coalesce("supported", F.lit(False)), F.coalesce(~F.col("supported"), F.lit(False))
    keep = lambda c: F.col(c)
    return rows.select(
        "id", F.when(yes, "ok").when(no, "drifted").otherwise(keep("status")).alias("status"), F.when(yes, F.col("current_hash")).otherwise(keep("verified_hash")).alias("verified_hash"),
        F.when(no, F.col("reason")).when(~yes, keep("drift")).alias("drift"), F.when(no, F.coalesce("corrected", keep("suggested"))).when(~yes, keep("suggested")).alias("suggested"),
    )


def responds(claims: DataFrame, responses: DataFrame) -> DataFrame:
    """(claim, kind) of the distinct claims(claim) that a URL responds, against responses(url, status, body), one
    row for each URL that was asked: skip where it wasn't reached, fail for another status or a body
    without the text, else pass."""
    c = F.col("claim")
    asked = claims.where(c.rlike(RESPONDS)).select("claim").distinct()
    asked = asked.select("claim", group(c, RESPONDS, 1).alias("url"), group(c, RESPONDS, 2).cast("decimal(38,0)").alias("wanted"), group(c, RESPONDS, 3).alias("said"))
    rows = asked.join(responses.select("url", "status", "body"), "url", "left")
    there = F.col("said").isNull() | F.coalesce(F.contains(F.col("body"), F.col("said")), F.lit(False))
    kind = F.when(F.col("status").isNull(), "skip").when((F.col("status") == F.col("wanted")) & there, "pass").otherwise("fail")
    return rows.select("claim", kind.alias("kind"))


def typechecks(claims: DataFrame, results: DataFrame) -> DataFrame:
    """claims that the code typechecks, plus kind by results(passed) of the checkers that ran: fail if one failed, skip if none ran."""
    every = results.agg(F.bool_and("passed").alias("_passed"))  # one row
    kind = F.when(F.col("_passed").isNull(), "skip").when(F.col("_passed"), "pass").otherwise("fail")
    return claims.where(F.col("claim").rlike(TYPECHECKS)).join(F.broadcast(every)).withColumn("kind", kind).drop("_passed")
