"""Ledger, ratchet and diff queries over events, conversations, orders and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import activity as V
from strata.operators import assembly as A
from strata.operators import history as H
from strata.operators import ledger as L
from strata.operators import ratchet as D
from strata.operators.claims import fitting_prefix
from strata.plans import roles as R


def _activity(spark, d):
    e = R.table(spark, d, "events")
    key = F.when(F.col("event_id") % 11 != 0, F.sha2(F.concat_ws("|", "user_id", "event_type", "props"), 256))
    return e.select(key.alias("replay_key"), F.col("event_type").alias("event"), "user_id", F.col("event_id").alias("ord"), "ts", "value")


def activity_counts(spark, d):
    return L.activity_counts(_activity(spark, d))


def activity_latest(spark, d):
    """Per user what is left after replays, and the latest event."""
    rows = L.last_wins(_activity(spark, d), ["replay_key"], "ord")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.max_by("event", "ord").alias("latest"))


def command_counts(spark, d):
    e = R.table(spark, d, "events")
    result = F.when(F.col("value") > 80, "failure").when(F.col("value") > 20, "success")
    return L.command_counts(e.select(F.col("event_type").alias("kind"), result.alias("result")))


def _records(spark, d):
    """Turns as records: the first of a conversation is its header; some act on earlier ones."""
    c = R.table(spark, d, "conversations")
    kinds = F.array(*[F.lit(x) for x in ("decision", "conjecture", "blocked", "conjecture", "resolution", "retraction", "dismissal")])
    k = F.col("conv_id") * 100 + F.col("turn")
    kind = F.when(F.col("turn") == 0, "session").otherwise(F.element_at(kinds, (F.pmod(F.col("conv_id") + F.col("turn") * 3, F.lit(7)) + 1).cast("int")))
    return c.select(
        F.concat(F.lit("d-"), k).alias("id"), F.concat(F.lit("s-"), "conv_id").alias("session"), kind.alias("kind"),
        F.when(F.col("turn") >= 2, F.concat(F.lit("d-"), k - 1 - F.pmod(F.col("conv_id"), F.lit(2)))).alias("supersedes"),
        k.alias("ord"), F.lpad(k.cast("string"), 20, "0").alias("at"), F.col("role").alias("agent"),
    )


def ledger_supersession(spark, d):
    return L.resolve(_records(spark, d)).select("id", "state", "by")


def session_summary(spark, d):
    return L.sessions(_records(spark, d))


def decision_positions(spark, d):
    o = R.table(spark, d, "orders")
    authority = F.when(F.col("o_orderpriority") == "1-URGENT", "user-directed").when(F.col("o_orderpriority") == "2-HIGH", "orchestrator-accepted").when(F.col("o_orderpriority") == "3-MEDIUM", "local-proposal")
    rows = o.select(F.col("o_orderkey").alias("id"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("at"), F.col("o_custkey").alias("subject"), F.col("o_orderstatus").alias("chose"), authority.alias("authority"))
    return L.positions(rows).select("subject", "state", F.array_join("choices", ",").alias("choices"), "selected")


def observed_band(spark, d):
    """Mean value of each event type and user group against the type's mean."""
    e = R.table(spark, d, "events")
    per = e.groupBy("event_type", (F.col("user_id") % 50).alias("g")).agg((F.floor(F.avg("value") * 100) / 100).alias("value"))
    base = e.groupBy("event_type").agg((F.floor(F.avg("value") * 100) / 100).alias("baseline"))
    rows = per.join(base, "event_type").withColumn("threshold", F.lit(5.0)).withColumn("metric", F.concat_ws("|", "event_type", "g"))
    priors = rows.where("g < 20").select("metric", F.when(F.col("g") < 10, F.col("metric")).alias("open_id"), F.when(F.col("g") >= 10, F.lit("t")).alias("resolved_at"))
    return L.observe(rows.select("metric", "value", "baseline", "threshold"), priors).select("metric", "value", "baseline", "outside", "action")


def raised_findings(spark, d):
    p = R.table(spark, d, "part")
    findings = p.where("p_size > 45").select(F.col("p_brand").alias("advisory"), F.col("p_partkey").cast("string").alias("subject"), F.col("p_partkey").alias("ord"))
    known = findings.select(F.concat_ws(":", "advisory", "subject").alias("finding"), F.when(F.col("ord") % 5 == 0, "o").alias("open_id"), F.when(F.col("ord") % 5 == 1, "x").alias("settled_id"))
    return L.raise_findings(findings, known, cap=7)


def merged_claims(spark, d):
    o = R.table(spark, d, "orders")
    kinds = F.array(*[F.lit(x) for x in ("pass", "fail", "skip")])
    rows = lambda c, at: o.where(c).select((F.col("o_custkey") % 40).alias("node"), F.col("o_orderkey").alias("claim"), F.element_at(kinds, ((F.col("o_orderkey") / at).cast("long") % 3 + 1).cast("int")).alias("kind"))
    before = rows("o_orderpriority <> '1-URGENT'", 4).withColumns({"ever_failed": F.col("kind") == "fail", "runs": (F.col("claim") % 4).cast("int")})
    scope = spark.range(20).select(F.col("id").alias("node"))
    return L.merge_claims(before, rows("o_orderpriority <> '5-LOW'", 7), scope)


def experiment_outcomes(spark, d):
    li = R.table(spark, d, "lineitem")
    status = F.when(F.col("l_returnflag") == "R", "unmet").when(F.col("l_returnflag") == "A", "met").otherwise("unknown")
    return L.experiment_outcome(li.select(F.col("l_suppkey").alias("experiment"), F.lit("c").alias("id"), status.alias("status")).unionByName(li.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("experiment"), F.lit("d").alias("id"), F.lit("met").alias("status"))))


def result_totality(spark, d):
    li = R.table(spark, d, "lineitem")
    expected = R.table(spark, d, "orders").select(F.col("o_orderkey").alias("experiment"), F.lit(1).alias("id"))
    supplied = li.where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("experiment"), F.col("l_linenumber").alias("id"))
    return L.totality(expected, supplied)


def dangling_refs(spark, d):
    o = R.table(spark, d, "orders")
    ref = lambda k, i: F.struct(F.lit(k).alias("kind"), i.cast("string").alias("id"))
    links = o.select(F.col("o_orderkey").alias("id"), ref("customer", F.col("o_custkey")).alias("from"), ref("order", F.col("o_orderkey") + 1).alias("to"))
    known = R.table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select(F.lit("customer").alias("kind"), F.col("c_custkey").cast("string").alias("id")).unionByName(o.select(F.lit("order").alias("kind"), F.col("o_orderkey").cast("string").alias("id")))
    return L.dangling(links, known).select("kind", "id", F.size("links").alias("links"), F.get("links", F.lit(0)).alias("least"))


def _dims(spark, d, at):
    o = R.table(spark, d, "orders").where(f"year(o_orderdate) {at}")
    return o.groupBy(F.concat_ws("|", "o_orderstatus", (F.col("o_custkey") % 30).cast("string")).alias("key")).agg(F.count("*").cast("double").alias("value"))


def mass_excursions(spark, d):
    tolerance = spark.range(30).select(F.concat(F.lit("O|"), F.col("id").cast("string")).alias("key"), F.lit(5.0).alias("tolerance"))
    return D.excursions(_dims(spark, d, ">= 1996"), _dims(spark, d, "< 1996"), tolerance)


def _names(spark, d, odd):
    p = R.table(spark, d, "part")
    new = F.concat(F.lit("symbols|"), F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("moved/"), "p_name", "p_partkey")).otherwise(F.concat("p_name", "p_partkey")))
    key = new if odd else F.concat(F.lit("symbols|"), "p_name", "p_partkey")
    rows = p.where("p_size <> 7") if odd else p
    return rows.select(key.alias("key"), F.col("p_size").cast("double").alias("value"), F.col("p_brand").alias("unit"))


def mass_reconcile(spark, d):
    return D.reconcile(_names(spark, d, True), _names(spark, d, False))


def effective_baseline(spark, d):
    return D.effective_base(_names(spark, d, True), _names(spark, d, False))


def snapshot_diff(spark, d):
    o = R.table(spark, d, "orders")
    shot = lambda c: o.where(c).groupBy("o_custkey").agg(F.max("o_orderstatus").alias("status"), F.count("*").alias("n"))
    return D.diff(shot("year(o_orderdate) < 1996"), shot("year(o_orderdate) >= 1996"), ["o_custkey"], ["status", "n"])


def _surface(spark, d, c):
    """Pairs of part and supplier as exports, parts under a return flag as variants of a domain."""
    li = R.table(spark, d, "lineitem").where(c)
    exports = li.select(F.lit("export").alias("kind"), F.concat_ws("/", "l_partkey", "l_suppkey").alias("name"), F.lit("").alias("member"))
    return exports.unionByName(li.select(F.lit("domain").alias("kind"), F.col("l_returnflag").alias("name"), F.col("l_partkey").cast("string").alias("member")))


def surface_delta(spark, d):
    return D.surface_delta(_surface(spark, d, "year(l_shipdate) < 1996"), _surface(spark, d, "year(l_shipdate) >= 1996"))


def novelty_verdicts(spark, d):
    o = R.table(spark, d, "orders")
    rows = o.groupBy("o_custkey").agg(
        F.count("*").alias("new_exports"), F.count_distinct("o_orderpriority").alias("new_variants"), F.sum((F.col("o_orderkey") % 50)).alias("loc_added"),
        F.sum((F.col("o_orderkey") % 31)).alias("loc_deleted"), F.count_if(F.col("o_orderstatus") == "P").alias("anchors_added"),
    )
    states = D.signal_state(D.novelty(rows, min_loc=250).withColumn("attested", F.col("o_custkey") % 2 == 0))
    return states.select("o_custkey", "surface", "level", "proviso", "state")


def hook_observation(spark, d):
    e = R.table(spark, d, "events")
    return A.hook_observation(e.select(F.col("user_id").alias("session"), F.nullif("event_type", F.lit("view")).alias("bundle_hash")), "purchase")


def due_sections(spark, d):
    """For each priority the orders since its last one, by a distributed row number."""
    o = R.table(spark, d, "orders")
    placed, _ = H.places(o.select(F.col("o_orderkey").alias("hash"), "o_orderdate"), F.desc("o_orderdate"), F.desc("hash"))
    sections = o.groupBy(F.col("o_orderpriority").alias("section")).agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("commit"))
    known = sections.unionByName(spark.createDataFrame([("lost", -1)], "section string, commit long"))
    return A.due(known, placed.select("hash", (F.col("place") - 1).alias("ord")))


def structural_dims(spark, d):
    p, s = R.table(spark, d, "part"), R.table(spark, d, "supplier")
    prose = F.when(F.col("p_size") > 10, F.col("p_type")).otherwise(F.lit(" "))
    symbols = p.select(F.concat(F.lit("s:"), "p_partkey").alias("id"), F.lit("symbol").alias("kind"), F.col("p_brand").alias("component"), R.part_path().alias("path"), prose.alias("prose"))
    files = s.select(F.concat(F.lit("f:"), "s_suppkey").alias("id"), F.lit("file").alias("kind"), F.nullif(F.concat(F.lit("n:"), "s_nationkey"), F.lit("n:3")).alias("component"), R.supplier_path().alias("path"), F.lit(None).cast("string").alias("prose"))
    return D.structural_dims(symbols.unionByName(files), s.select(R.supplier_path().alias("path"), (F.col("s_suppkey") % 100).alias("lines")))


def budgeted_context(spark, d):
    """The turns of each conversation that fit 3,000 bytes with a footer about the withheld ones."""
    c = R.table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("ord"), F.octet_length("text").alias("bytes"))
    return fitting_prefix(c, 3000, 25)


def attributed_activity(spark, d):
    """Events as host payloads: whose they are, their identity, and the commands they show."""
    e = R.table(spark, d, "events")
    body = F.struct(
        F.when(F.col("value") > 10, F.concat(F.lit("u"), "user_id")).alias("session_id"), F.when(F.col("event_type") == "purchase", F.concat(F.lit("a"), "user_id")).alias("agent_id"), F.lit("Bash").alias("tool_name"),
        F.struct(F.concat(F.lit("tool "), F.when(F.col("value") > 50, "verify").otherwise("list"), F.lit(" --fast")).alias("command")).alias("tool_input"),
        F.struct(F.when(F.col("value") > 60, F.floor(F.col("value") / 80).cast("int")).alias("exit_code")).alias("tool_response"),
    )
    rows = e.select("event_id", F.when(F.col("event_type") == "click", "PostToolUse").otherwise("Stop").alias("event"), F.to_json(body).alias("payload"))
    rows = rows.select("event_id", V.attribution(F.col("event"), F.col("payload")).alias("a"), V.command(F.col("payload"), "tool").alias("c"))
    return rows.select("event_id", "a.session", "a.parent_session", "a.agent_id", "a.attribution", "c.kind", "c.result", "c.exit_code")


QUERIES = {
    f.__name__: f
    for f in (
        hook_observation, due_sections, structural_dims, budgeted_context, attributed_activity,
        activity_counts, activity_latest, command_counts, ledger_supersession, session_summary, decision_positions, observed_band, raised_findings, merged_claims,
        experiment_outcomes, result_totality, dangling_refs, mass_excursions, mass_reconcile, effective_baseline, snapshot_diff, surface_delta, novelty_verdicts,
    )
}

_LEFT = """e AS (SELECT *, CASE WHEN event_id % 11 <> 0 THEN user_id || '|' || event_type || '|' || props END AS k FROM events),
left_ AS (SELECT * FROM e WHERE k IS NULL UNION ALL SELECT * FROM (SELECT * FROM e WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY event_id DESC) = 1))"""

_RECORDS = """rec AS (SELECT 'd-' || (conv_id * 100 + turn) AS id, 's-' || conv_id AS session,
  CASE WHEN turn = 0 THEN 'session' ELSE list_extract(['decision', 'conjecture', 'blocked', 'conjecture', 'resolution', 'retraction', 'dismissal'], CAST((conv_id + turn * 3) % 7 + 1 AS INTEGER)) END AS kind,
  CASE WHEN turn >= 2 THEN 'd-' || (conv_id * 100 + turn - 1 - conv_id % 2) END AS supersedes, conv_id * 100 + turn AS ord, lpad(CAST(conv_id * 100 + turn AS VARCHAR), 20, '0') AS "at", role AS agent FROM conversations)"""

_NAMES = """cur AS (SELECT 'symbols|' || CASE WHEN p_partkey % 4 = 0 THEN 'moved/' || p_name || p_partkey ELSE p_name || p_partkey END AS key, CAST(p_size AS DOUBLE) AS value, p_brand AS unit FROM part WHERE p_size <> 7),
base AS (SELECT 'symbols|' || p_name || p_partkey AS key, CAST(p_size AS DOUBLE) AS value, p_brand AS unit FROM part),
gone AS (SELECT *, row_number() OVER (PARTITION BY unit, value ORDER BY key) AS r FROM base ANTI JOIN cur USING (key)),
new AS (SELECT *, row_number() OVER (PARTITION BY unit, value ORDER BY key) AS r FROM cur ANTI JOIN base USING (key)),
moved AS (SELECT gone.key AS "from", new.key AS "to", new.value FROM gone JOIN new USING (unit, value, r))"""

_SURFACE = """s AS (SELECT 'export' AS kind, l_partkey || '/' || l_suppkey AS name, '' AS member, year(l_shipdate) < 1996 AS old FROM lineitem
 UNION ALL SELECT 'domain', l_returnflag, CAST(l_partkey AS VARCHAR), year(l_shipdate) < 1996 FROM lineitem),
b AS (SELECT DISTINCT kind, name, member FROM s WHERE old), a AS (SELECT DISTINCT kind, name, member FROM s WHERE NOT old)"""

SQL = {
    "hook_observation": """WITH n AS (SELECT user_id AS session, count(*) FILTER (WHERE event_type = 'purchase') AS exact, count(*) FILTER (WHERE event_type NOT IN ('purchase', 'view')) AS stale, count(*) FILTER (WHERE event_type = 'view') AS direct FROM events GROUP BY 1)
        SELECT *, CASE WHEN exact > 0 THEN 'observed' WHEN stale > 0 THEN 'stale' ELSE 'unobserved' END AS state FROM n""",
    "due_sections": """WITH o AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS ord FROM orders),
        s AS (SELECT o_orderpriority AS section, max(ord) AS commits FROM o GROUP BY 1 UNION ALL SELECT 'lost', NULL), r AS (SELECT *, row_number() OVER (ORDER BY commits DESC NULLS LAST, section) AS r FROM s)
        SELECT section, commits, CASE WHEN commits IS NULL THEN 'uncountable' WHEN commits < 10 THEN 'current' WHEN r <= 3 THEN 'due' ELSE 'withheld' END AS state FROM r""",
    "structural_dims": """WITH f AS (SELECT CASE WHEN s_nationkey <> 3 THEN 'n:' || s_nationkey ELSE '(unowned)' END AS c, s_suppkey % 100 AS lines FROM supplier)
        SELECT 'lines|' || c AS key, CAST(sum(lines) AS DOUBLE) AS value, 'lines' AS unit FROM f GROUP BY 1 UNION ALL SELECT 'lines|total', CAST(sum(lines) AS DOUBLE), 'lines' FROM f
        UNION ALL SELECT 'files|total', CAST(count(*) AS DOUBLE), 'files' FROM supplier UNION ALL SELECT 'symbols|total', CAST(count(*) AS DOUBLE), 'symbols' FROM part UNION ALL SELECT 'undocumented|symbols', CAST(count(*) FILTER (WHERE p_size <= 10) AS DOUBLE), 'symbols' FROM part""",
    "budgeted_context": """WITH r AS (SELECT conv_id AS doc, turn AS ord, CAST(octet_length(encode(text)) AS INTEGER) AS bytes, row_number() OVER w AS n, sum(octet_length(encode(text))) OVER w AS s, count(*) OVER (PARTITION BY conv_id) - row_number() OVER w AS rest FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        m AS (SELECT doc, max(n) AS most FROM r WHERE s + CASE WHEN rest > 0 THEN 25 + length(CAST(rest AS VARCHAR)) ELSE 0 END <= 3000 GROUP BY doc) SELECT r.doc, ord, bytes FROM r JOIN m ON m.doc = r.doc AND n <= most""",
    "attributed_activity": """WITH e AS (SELECT event_id, event_type = 'click' AS shared, CASE WHEN value > 10 THEN 'u' || user_id END AS parent, CASE WHEN event_type = 'purchase' THEN 'a' || user_id END AS agent, CASE WHEN value > 60 THEN CAST(floor(value / 80) AS INTEGER) END AS code, value > 50 AS v FROM events)
        SELECT event_id, coalesce(agent, parent, 'unknown') AS session, CASE WHEN agent IS NOT NULL OR shared THEN parent END AS parent_session, agent AS agent_id,
               CASE WHEN agent IS NOT NULL THEN 'agent' WHEN parent IS NULL THEN 'unknown' WHEN shared THEN 'parent-fallback' ELSE 'session' END AS attribution,
               CASE WHEN v THEN 'verification' END AS kind, CASE WHEN NOT coalesce(v, false) THEN NULL WHEN code IS NULL THEN 'unknown' WHEN code = 0 THEN 'success' ELSE 'failure' END AS result, CASE WHEN v THEN code END AS exit_code FROM e""",
    "activity_counts": f"WITH {_LEFT} SELECT event_type AS event, count(*) AS n FROM left_ GROUP BY 1",
    "activity_latest": f"WITH {_LEFT} SELECT user_id, count(*) AS n, arg_max(event_type, event_id) AS latest FROM left_ GROUP BY 1",
    "command_counts": """SELECT event_type AS kind, count(*) AS total, count(*) FILTER (WHERE value > 20 AND value <= 80) AS success, count(*) FILTER (WHERE value > 80) AS failure,
        count(*) FILTER (WHERE value <= 20 OR value IS NULL) AS unknown FROM events GROUP BY 1""",
    "ledger_supersession": f"""WITH {_RECORDS}, r AS (SELECT * FROM rec WHERE kind <> 'session'),
        w AS (SELECT supersedes AS id, arg_max(id, ord) AS by FROM r WHERE kind = 'retraction' AND supersedes IS NOT NULL GROUP BY 1),
        alive AS (SELECT * FROM r WHERE supersedes IS NOT NULL AND id NOT IN (SELECT id FROM w)),
        a AS (SELECT supersedes AS id, arg_max(id, ord) AS by FROM alive WHERE kind = 'resolution' GROUP BY 1),
        x AS (SELECT supersedes AS id, arg_max(id, ord) AS by FROM alive WHERE kind = 'dismissal' GROUP BY 1),
        s AS (SELECT r.id, CASE WHEN w.by IS NOT NULL THEN 'retracted' WHEN kind IN ('retraction', 'resolution', 'dismissal') THEN NULL
              WHEN kind = 'conjecture' AND a.by IS NOT NULL THEN 'resolved' WHEN kind = 'conjecture' AND x.by IS NOT NULL THEN 'dismissed' WHEN kind = 'conjecture' THEN 'open'
              WHEN kind = 'blocked' THEN 'blocked' ELSE 'standing' END AS state, w.by AS wb, a.by AS ab, x.by AS xb FROM r LEFT JOIN w ON w.id = r.id LEFT JOIN a ON a.id = r.id LEFT JOIN x ON x.id = r.id)
        SELECT id, state, CASE state WHEN 'retracted' THEN wb WHEN 'resolved' THEN ab WHEN 'dismissed' THEN xb END AS by FROM s WHERE state IS NOT NULL""",
    "session_summary": f"""WITH {_RECORDS} SELECT session, min("at") AS "start", max("at") AS "last", count(*) FILTER (WHERE kind <> 'session') AS entries, arg_max(agent, "at") AS agent FROM rec GROUP BY session""",
    "decision_positions": """WITH r AS (SELECT o_orderkey AS id, o_custkey AS subject, o_orderstatus AS chose, CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 1 ELSE 0 END AS rank FROM orders),
        t AS (SELECT *, max(rank) OVER (PARTITION BY subject) AS top FROM r),
        g AS (SELECT subject, any_value(top) AS top, list_sort(list_distinct(list(chose))) AS choices, count(DISTINCT chose) FILTER (WHERE rank = top AND rank > 0) AS n_lead, max(id) AS latest, max(id) FILTER (WHERE rank = top AND rank > 0) AS leader FROM t GROUP BY subject),
        s AS (SELECT *, CASE WHEN len(choices) = 1 THEN 'aligned' WHEN top >= 2 AND n_lead = 1 THEN 'ratified' WHEN top <= 1 THEN 'needs-ratification' ELSE 'contested' END AS state FROM g)
        SELECT subject, state, array_to_string(choices, ',') AS choices, CASE state WHEN 'aligned' THEN latest WHEN 'ratified' THEN leader END AS selected FROM s""",
    "observed_band": """WITH p AS (SELECT event_type, user_id % 50 AS g, floor(avg(value) * 100) / 100 AS value FROM events GROUP BY 1, 2), b AS (SELECT event_type, floor(avg(value) * 100) / 100 AS baseline FROM events GROUP BY 1),
        r AS (SELECT event_type || '|' || g AS metric, g, value, baseline, abs(value - baseline) >= 5.0 AS outside FROM p JOIN b USING (event_type))
        SELECT metric, value, baseline, outside, CASE WHEN outside AND g < 10 THEN 'already-open' WHEN outside AND g < 20 THEN 'reopen' WHEN outside THEN 'open' WHEN g < 10 THEN 'close' ELSE 'within' END AS action FROM r""",
    "raised_findings": """WITH f AS (SELECT p_brand AS advisory, CAST(p_partkey AS VARCHAR) AS subject, p_partkey AS ord, CASE p_partkey % 5 WHEN 0 THEN 'already-open' WHEN 1 THEN 'settled' ELSE 'fresh' END AS state FROM part WHERE p_size > 45),
        t AS (SELECT *, row_number() OVER (PARTITION BY advisory ORDER BY ord, subject) AS turn, min(ord) OVER (PARTITION BY advisory) AS lane FROM f WHERE state = 'fresh'),
        h AS (SELECT subject, advisory FROM t ORDER BY turn, lane, subject LIMIT 7)
        SELECT f.advisory || ':' || f.subject AS finding, f.advisory, f.subject, CASE WHEN state <> 'fresh' THEN state WHEN h.subject IS NOT NULL THEN 'raised' ELSE 'withheld' END AS outcome FROM f LEFT JOIN h ON h.subject = f.subject AND h.advisory = f.advisory""",
    "merged_claims": """WITH b AS (SELECT o_custkey % 40 AS node, o_orderkey AS claim, list_extract(['pass', 'fail', 'skip'], CAST((o_orderkey // 4) % 3 + 1 AS INTEGER)) AS kind, CAST(o_orderkey % 4 AS INTEGER) AS runs FROM orders WHERE o_orderpriority <> '1-URGENT'),
        f AS (SELECT o_custkey % 40 AS node, o_orderkey AS claim, list_extract(['pass', 'fail', 'skip'], CAST((o_orderkey // 7) % 3 + 1 AS INTEGER)) AS kind FROM orders WHERE o_orderpriority <> '5-LOW')
        SELECT coalesce(b.node, f.node) AS node, coalesce(b.claim, f.claim) AS claim, CASE WHEN f.kind <> 'skip' THEN f.kind ELSE coalesce(b.kind, f.kind) END AS kind,
               coalesce(b.kind = 'fail', false) OR coalesce(f.kind = 'fail', false) AS ever_failed, coalesce(b.runs, 0) + CASE WHEN f.kind <> 'skip' THEN 1 ELSE 0 END AS runs
        FROM b FULL JOIN f ON b.node = f.node AND b.claim = f.claim WHERE f.kind IS NOT NULL OR coalesce(b.node, f.node) >= 20""",
    "experiment_outcomes": """WITH r AS (SELECT l_suppkey AS experiment, CASE l_returnflag WHEN 'R' THEN 'unmet' WHEN 'A' THEN 'met' ELSE 'unknown' END AS status FROM lineitem UNION ALL SELECT l_orderkey, 'met' FROM lineitem WHERE l_returnflag = 'A')
        SELECT experiment, CASE WHEN bool_or(status = 'unmet') THEN 'failure' WHEN bool_and(status = 'met') THEN 'success' ELSE 'inconclusive' END AS outcome FROM r GROUP BY 1""",
    "result_totality": """WITH e AS (SELECT o_orderkey AS experiment, 1 AS id FROM orders), s AS (SELECT l_orderkey AS experiment, l_linenumber AS id, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2)
        SELECT coalesce(e.experiment, s.experiment) AS experiment, CAST(coalesce(e.id, s.id) AS INTEGER) AS id, CASE WHEN e.id IS NULL THEN 'unplanned' WHEN s.n IS NULL THEN 'missing' ELSE 'repeated' END AS damage
        FROM e FULL JOIN s ON e.experiment = s.experiment AND e.id = s.id WHERE e.id IS NULL OR s.n IS NULL OR s.n > 1""",
    "dangling_refs": """WITH ends AS (SELECT o_orderkey AS link, 'customer' AS kind, o_custkey AS id FROM orders UNION ALL SELECT o_orderkey, 'order', o_orderkey + 1 FROM orders),
        known AS (SELECT 'customer' AS kind, c_custkey AS id FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT 'order', o_orderkey FROM orders)
        SELECT kind, CAST(id AS VARCHAR) AS id, CAST(count(DISTINCT link) AS INTEGER) AS links, min(link) AS least FROM ends ANTI JOIN known USING (kind, id) GROUP BY kind, id""",
    "mass_excursions": """WITH b AS (SELECT o_orderstatus || '|' || (o_custkey % 30) AS key, CAST(count(*) AS DOUBLE) AS value FROM orders WHERE year(o_orderdate) < 1996 GROUP BY 1),
        c AS (SELECT o_orderstatus || '|' || (o_custkey % 30) AS key, CAST(count(*) AS DOUBLE) AS value FROM orders WHERE year(o_orderdate) >= 1996 GROUP BY 1),
        r AS (SELECT c.key, c.value, b.value AS baseline, CASE WHEN c.key LIKE 'O|%' THEN 5.0 ELSE 0.0 END AS tolerance FROM c LEFT JOIN b USING (key))
        SELECT key, value, baseline, CAST(tolerance AS DOUBLE) AS tolerance FROM r WHERE baseline IS NULL OR value > baseline + tolerance""",
    "mass_reconcile": f'WITH {_NAMES} SELECT "from", "to", value FROM moved',
    "effective_baseline": f'WITH {_NAMES} SELECT coalesce("to", key) AS key, base.value, unit FROM base LEFT JOIN moved ON "from" = key',
    "snapshot_diff": """WITH b AS (SELECT o_custkey, max(o_orderstatus) AS status, count(*) AS n FROM orders WHERE year(o_orderdate) < 1996 GROUP BY 1), a AS (SELECT o_custkey, max(o_orderstatus) AS status, count(*) AS n FROM orders WHERE year(o_orderdate) >= 1996 GROUP BY 1)
        SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN b.o_custkey IS NULL THEN 'added' WHEN a.o_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change
        FROM a FULL JOIN b ON a.o_custkey = b.o_custkey WHERE a.o_custkey IS NULL OR b.o_custkey IS NULL OR a.status <> b.status OR a.n <> b.n""",
    "surface_delta": f"""WITH {_SURFACE}, n AS (SELECT * FROM a EXCEPT SELECT * FROM b), o AS (SELECT * FROM b EXCEPT SELECT * FROM a)
        SELECT (SELECT count(*) FROM n WHERE kind = 'export') AS new_exports, (SELECT count(*) FROM o WHERE kind = 'export') AS removed_exports, (SELECT count(*) FROM n WHERE kind = 'domain') AS new_variants""",
    "novelty_verdicts": """WITH r AS (SELECT o_custkey, count(*) + count(DISTINCT o_orderpriority) AS surface, CAST(sum(o_orderkey % 50) AS BIGINT) AS added, CAST(sum(o_orderkey % 31) AS BIGINT) AS deleted, count(*) FILTER (WHERE o_orderstatus = 'P') AS anchors FROM orders GROUP BY 1),
        l AS (SELECT *, CASE WHEN anchors = 0 AND (surface >= 8 OR added >= 250) THEN 'alarm' WHEN anchors > 0 AND surface >= 8 AND surface > anchors * 12 THEN 'outpacing' ELSE 'quiet' END AS level FROM r)
        SELECT o_custkey, surface, level, level <> 'quiet' AND (surface < 8 OR deleted * 2 >= added) AS proviso,
               CASE WHEN level = 'quiet' THEN 'quiet' WHEN level <> 'alarm' OR anchors > 0 THEN 'anchored' WHEN o_custkey % 2 = 0 THEN 'attested' ELSE 'needs-decision' END AS state FROM l""",
}
