"""Readings of work, links, context, conventions and claims over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import assembly as A
from strata.operators.graph import ENDED
from strata.plans import roles as R
from strata.plans.graph_queries import WORKS, works
from strata.sources.shared import materialize


def _pick(names, n):
    """The n-th of some names, counted from 0."""
    return F.element_at(F.array(*[F.lit(x) for x in names]), (n + 1).cast("int"))


def _text(c):
    return c.cast("string")


#: What becomes of a work's state with each of its lines.
_TO = ("active", "blocked", "open")


def work_events(spark, d):
    """Each order is a work; its lines are events after one another, by their own numbers, with breaks:
    lines that follow the one before the last, none, or the order of another work, closings in the
    middle, hand-offs, and orders that are opened twice or never."""
    li = R.table(spark, d, "lineitem")
    o = R.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    from pyspark.sql import Window

    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    rows = li.withColumn("n", F.row_number().over(by)).select(F.col("l_orderkey").alias("k"), "n", F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    line = Window.partitionBy("k").orderBy("n")
    i = lambda k, n: F.concat(_text(k), F.lit("-"), _text(n))
    kind = F.when(F.col("p") % 7 == 0, "handed-off").when(F.col("p") % 11 == 0, "closed").otherwise("transitioned")
    rows = rows.withColumns({"event": kind, "to": F.when(kind == "transitioned", _pick(_TO, F.col("p") % 3)).when(kind == "closed", F.when(F.col("p") % 2 == 0, "completed").otherwise("cancelled"))})
    before = F.coalesce(F.last("to", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit("open"))
    holder = F.coalesce(F.last(F.when(F.col("event") == "handed-off", _text(F.col("s") % 5)), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit("a"))
    rows = rows.withColumns({"before": before, "holder": holder})
    previous = F.when(F.col("s") % 37 == 0, i(F.col("k"), F.greatest(F.col("n") - 2, F.lit(0)))).when(F.col("s") % 41 == 0, F.lit("nowhere")).when(F.col("s") % 43 == 0, i(F.col("k") - 1, F.lit(0))).otherwise(i(F.col("k"), F.col("n") - 1))
    later = rows.select(
        _text(F.col("k")).alias("work"), "event", i(F.col("k"), F.col("n")).alias("id"), previous.alias("previous"), F.when(F.col("event") != "handed-off", F.when(F.col("s") % 19 == 0, "blocked").otherwise(F.col("before"))).alias("from"),
        "to", F.lit(None).cast("string").alias("owner"), F.when(F.col("event") == "handed-off", F.when(F.col("p") % 13 == 0, "z").otherwise(F.col("holder"))).alias("from_owner"), F.when(F.col("event") == "handed-off", _text(F.col("s") % 5)).alias("to_owner"),
    )
    none = F.lit(None).cast("string")
    opened = lambda rows, n: rows.select(_text(F.col("k")).alias("work"), F.lit("opened").alias("event"), i(F.col("k"), F.lit(n)).alias("id"), none.alias("previous"), none.alias("from"), none.alias("to"), F.lit("a").alias("owner"), none.alias("from_owner"), none.alias("to_owner"))
    return opened(o.where("k % 59 <> 3"), 0).unionByName(opened(o.where("k % 61 = 5"), 99)).unionByName(later)


def work_items(spark, d):
    return A.work_items(work_events(spark, d))


def work_problems(spark, d):
    return A.work_problems(work_events(spark, d))


def work_ledger(spark, d):
    w, needs, took, scopes = works(spark, d)
    rows = A.work_ledger(w, needs, scopes, took)[0]
    return rows.select("work", "readiness", F.array_join("conflicts", " ").alias("conflicts"), "obstructed")


def work_overlaps(spark, d):
    w, needs, took, scopes = works(spark, d)
    return A.work_ledger(w, needs, scopes, took)[1]


def work_orphans(spark, d):
    w, needs, took, scopes = works(spark, d)
    return A.work_ledger(w, needs, scopes, took)[2]


def work_unsynthesized(spark, d):
    w, _, took, _ = works(spark, d)
    return A.unsynthesized(w, took)


def executable_synthesis(spark, d):
    w, _, took, _ = works(spark, d)
    return A.executable_synthesis(w, A.unsynthesized(w, took))


def work_stats(spark, d):
    w, needs, took, scopes = works(spark, d)
    return A.work_stats(A.work_summary(w, needs, scopes, took), needs, A.unsynthesized(w, took))


def assigned_work(spark, d):
    """What the owners of sessions 0 to 6 may do next."""
    from functools import reduce

    w, needs, took, scopes = works(spark, d)
    rows = A.work_summary(w, needs, scopes, took)[0].withColumn("owner_session", F.concat(F.lit("s"), _text(F.col("work").cast("long") % 7)))
    rows = materialize(rows.where(~F.col("state").isin(*ENDED)), "assigned")  # read twice for each session
    each = [A.assigned(rows, f"s{i}").select(F.lit(f"s{i}").alias("session"), "work", "state", "readiness", F.array_join("moves", " ").alias("moves"), "withheld") for i in range(7)]
    return reduce(lambda a, b: a.unionByName(b), each)


def relation_problems(spark, d):
    """Orders as links of every relation between records of every kind, some to themselves, some unknown."""
    k = F.col("o_orderkey")
    end = lambda kind, ident: F.struct(_pick((*A.KINDS, "person"), kind).alias("kind"), _text(ident).alias("id"))
    relations = (*[r for r, _, _ in A.RELATIONS], "causes")
    links = R.table(spark, d, "orders").select(k.alias("link"), end(k % 7, k % 2).alias("from"), _pick(relations, F.floor(k / 7) % len(relations)).alias("relation"), end(F.floor(k / 84) % 7, F.floor(k / 5) % 2).alias("to"))
    return A.inadmissible(links).select("link", "relation", "problem")


def _pages(spark, d):
    """Pages as files: every fifth is a test, owned by the first folder of its path."""
    p = R.page_paths(spark, d).select("page_id", "path")
    tail = F.when(F.col("page_id") % 5 == 0, ".test.ts").when(F.col("page_id") % 11 == 0, ".spec.md").otherwise(".ts")
    return p.select("page_id", F.concat(F.lit("f"), _text(F.col("page_id")), F.lit("/"), F.col("path"), tail).alias("path"), F.when(F.col("page_id") % 3 > 0, _text(F.col("page_id") % 29)).alias("component"))


def context_tests(spark, d):
    files = _pages(spark, d)
    imports = files.select(F.col("page_id"), F.col("path").alias("source")).join(files.select((F.col("page_id") - 3).alias("page_id"), F.col("path").alias("target")), "page_id").select("source", "target")
    return A.context_tests(files.where("page_id % 97 in (1, 10, 16)").select("path"), files.select("path", "component"), imports)


def _rules(spark, d):
    """Claims of parts: boundaries, parities, and texts that name parts by the end of their names."""
    p = R.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("component"), "p_name", "p_type")
    name = F.regexp_replace("p_name", "[^A-Za-z0-9]", "_")
    q = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    claim = (
        F.when(F.col("k") % 4 == 0, F.concat(F.lit("boundary "), q(F.col("p_type")), F.lit(" at s"), _text(F.col("k") % 40), F.when(F.col("k") % 8 == 0, F.lit(' via test "t"')).otherwise("")))
        .when(F.col("k") % 4 == 1, F.concat(F.lit("parity "), q(F.col("p_type")), F.lit(" over s"), _text(F.col("k") % 50), F.lit(" between f and g"), F.lit(' via test "both"')))
        .when(F.col("k") % 4 == 2, F.concat(F.lit("the file Src/Part"), _text(F.col("k") % 60), F.lit(".ts holds "), name))
        .otherwise(F.concat(F.lit("passes test "), q(F.concat(F.lit("S"), _text(F.col("k") % 45), F.lit(" and more")))))
    )
    return p.select("component", claim.alias("claim")).distinct()


def context_obligations(spark, d):
    claims = _rules(spark, d)
    one = lambda rows, c: spark.createDataFrame([(x,) for x in rows], f"{c} string")
    found = A.obligations(claims, one(["Brand#12"], "component"), one(["s10", "s30", "s31", "ab"], "symbol"), one(["src/part7.ts", "xy"], "term"))
    return found.select("component", "claim", "kind", "invariant", F.array_join("chokepoints", " ").alias("chokepoints"), F.array_join("oracles", " ").alias("oracles"))


def context_records(spark, d):
    """Orders as records whose reasons name parts of speech of their comments' place: clerks and priorities."""
    o = R.table(spark, d, "orders")
    records = o.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("Use Store"), _text(F.col("o_custkey") % 300), F.lit(" for it")).alias("chose"), F.concat(F.lit("see src/Unit"), _text(F.col("o_orderkey") % 210), F.lit(".ts: "), F.col("o_orderpriority")).alias("because"),
        F.array(F.col("o_orderstatus")).alias("over"), F.lit(None).cast("array<string>").alias("could_be"), F.lit(None).cast("string").alias("discriminated_by"),
        F.when(F.col("o_orderkey") % 3 == 0, F.array(F.concat(F.lit("src/u"), _text(F.col("o_orderkey") % 90), F.lit(".ts")))).alias("files"),
    )
    selection = spark.createDataFrame([("src/u30.ts",), ("src/u7.ts",)], "path string")
    terms = spark.createDataFrame([("store12",), ("Unit20.ts",), ("urgent",), ("1",), ("src/unit7.ts",), ("tore1",)], "term string")
    return A.context_records(records, selection, terms).select("id", F.array_join("matched_by", " ").alias("matched_by"))


#: Verbs of guards, and names that only begin like one or like none.
_VERBS = tuple(A.GUARD[2:-1].split("|")) + ("made", "helper")


def _guarded(spark, d):
    p = R.table(spark, d, "part").select(F.col("p_partkey").alias("k"))
    name = lambda n, m: F.concat(_pick(_VERBS, n % len(_VERBS)), F.lit("P"), _text(m))
    k = F.col("k")
    text = F.concat(
        F.lit("export function "), name(k, k % 31), F.lit("(a) {}\nexport const "), name(k + 3, k % 17), F.lit(" = async (b) => "), name(k + 5, k % 13), F.lit("(b);\nif ("), name(k * 7, k % 31), F.lit(" (x)) "), name(k + 3, k % 17), F.lit("(1)"),
    )
    return p.select(F.concat(F.lit("p"), _text(k)).alias("path"), text.alias("text"))


def guard_conventions(spark, d):
    src = _guarded(spark, d)
    one = lambda *rows: spark.createDataFrame([(x,) for x in rows], "name string")
    tests = spark.createDataFrame([("describe('totality of gates', () => { gateP3; sealP4 })",), ("it('plain', () => mintP1)",)], "text string")
    return A.conventions(A.guard_calls(src, seed=("helperP5",)), one("isP1", "hasP7", "mintP9"), A.totality_names(tests), one("canP2", "isP1"))


def word_expansions(spark, d):
    """Customers as words that conform to one another in chains of 25, rings and to words that don't exist."""
    claims, refused = A.expansions(_words(spark, d))
    return claims.select("word", "claim", F.col("depth").cast("string").alias("what")).unionByName(refused.select("word", F.lit(None).cast("string").alias("claim"), F.col("reason").alias("what")))


def _words(spark, d):
    c = R.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    said = lambda x: F.concat(F.lit("conforms to w"), _text(x))
    nxt = F.when(F.col("k") % 25 < 24, said(F.col("k") + 1)).when(F.floor(F.col("k") / 25) % 3 == 0, said(F.col("k") - 5)).when(F.floor(F.col("k") / 25) % 3 == 1, F.lit("conforms to gone"))
    own = F.when(F.col("k") % 10 == 0, F.lit("hello there")).otherwise(F.concat(F.lit("a"), _text(F.col("k") % 4), F.lit(" imports b")))
    return c.select(F.concat(F.lit("w"), _text(F.col("k"))).alias("word"), F.array_compact(F.array(own, nxt)).alias("claims"))


QUERIES = {
    f.__name__: f
    for f in (
        work_items, work_problems, work_ledger, work_overlaps, work_orphans, work_unsynthesized, executable_synthesis, work_stats, assigned_work, relation_problems, context_tests, context_obligations,
        context_records, guard_conventions, word_expansions,
    )
}

_EVENTS = """l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS n, l_partkey AS p, l_suppkey AS s FROM lineitem),
m AS (SELECT *, CASE WHEN p % 7 = 0 THEN 'handed-off' WHEN p % 11 = 0 THEN 'closed' ELSE 'transitioned' END AS event FROM l),
t AS (SELECT *, CASE WHEN event = 'transitioned' THEN list_extract(['active', 'blocked', 'open'], CAST(p % 3 + 1 AS INTEGER)) WHEN event = 'closed' THEN CASE WHEN p % 2 = 0 THEN 'completed' ELSE 'cancelled' END END AS "to" FROM m),
b AS (SELECT *, coalesce(last_value("to" IGNORE NULLS) OVER w, 'open') AS before, coalesce(last_value(CASE WHEN event = 'handed-off' THEN CAST(s % 5 AS VARCHAR) END IGNORE NULLS) OVER w, 'a') AS holder
  FROM t WINDOW w AS (PARTITION BY k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ev AS (SELECT CAST(k AS VARCHAR) AS work, event, k || '-' || n AS id, CASE WHEN s % 37 = 0 THEN k || '-' || greatest(n - 2, 0) WHEN s % 41 = 0 THEN 'nowhere' WHEN s % 43 = 0 THEN (k - 1) || '-0' ELSE k || '-' || (n - 1) END AS previous,
    CASE WHEN event <> 'handed-off' THEN CASE WHEN s % 19 = 0 THEN 'blocked' ELSE before END END AS "from", "to", CASE WHEN event = 'handed-off' THEN CASE WHEN p % 13 = 0 THEN 'z' ELSE holder END END AS from_owner,
    CASE WHEN event = 'handed-off' THEN CAST(s % 5 AS VARCHAR) END AS to_owner FROM b
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'opened', o_orderkey || '-0', NULL, NULL, NULL, NULL, NULL FROM orders WHERE o_orderkey % 59 <> 3
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'opened', o_orderkey || '-99', NULL, NULL, NULL, NULL, NULL FROM orders WHERE o_orderkey % 61 = 5),
openings AS (SELECT work, count(*) FILTER (WHERE event = 'opened') AS n FROM ev GROUP BY work),
e AS (SELECT ev.*, q.work AS pw FROM ev JOIN openings o ON o.work = ev.work AND o.n = 1 LEFT JOIN ev q ON q.id = ev.previous),
tree AS (SELECT work, id, 0 AS pos FROM e WHERE event = 'opened' UNION ALL SELECT e.work, e.id, tree.pos + 1 FROM tree JOIN e ON e.previous = tree.id AND e.work = tree.work AND e.event <> 'opened'),
fork AS (SELECT work, min(pos) AS pos FROM (SELECT work, pos FROM tree GROUP BY work, pos HAVING count(*) > 1) GROUP BY work),
chain AS (SELECT e.*, tree.pos, coalesce(bool_or(event = 'closed') OVER w, false) AS ended, coalesce(last_value(CASE WHEN event IN ('transitioned', 'closed') THEN "to" END IGNORE NULLS) OVER w, 'open') AS state,
    coalesce(last_value(to_owner IGNORE NULLS) OVER w, 'a') AS keeper
  FROM e JOIN tree USING (work, id) LEFT JOIN fork USING (work) WHERE fork.pos IS NULL OR tree.pos < fork.pos WINDOW w AS (PARTITION BY e.work ORDER BY tree.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""

_LEDGER = f"""{WORKS},
sc AS (SELECT work, k, CASE WHEN k % 31 = 0 THEN 'd' || (k % 397) ELSE 'd' || (k % 397) || '/f' || (k % 5) END AS base, k % 31 = 0 AS tree, 'd' || (k % 397) AS d FROM works WHERE state NOT IN ('completed', 'cancelled')),
met AS (SELECT a.work AS "left", b.work AS "right", CASE WHEN a.tree THEN a.base || '/**' ELSE a.base END AS left_scope, CASE WHEN b.tree THEN b.base || '/**' ELSE b.base END AS right_scope,
    CASE WHEN r.readiness IN ('ready', 'active') AND q.readiness IN ('ready', 'active') THEN 'conflict' ELSE 'potential' END AS status
  FROM sc a JOIN sc b ON a.d = b.d AND a.work < b.work AND (a.base = b.base OR a.tree OR b.tree) JOIN ready r ON r.work = a.work JOIN ready q ON q.work = b.work),
clash AS (SELECT w, string_agg(o, ' ' ORDER BY o) AS conflicts FROM (SELECT "left" AS w, "right" AS o FROM met WHERE status = 'conflict' UNION SELECT "right", "left" FROM met WHERE status = 'conflict') GROUP BY w),
led AS (SELECT works.*, CASE WHEN readiness = 'ready' AND conflicts IS NOT NULL THEN 'blocked' ELSE readiness END AS readiness, coalesce(conflicts, '') AS conflicts, works.work IN (SELECT work FROM problems) AS obstructed
  FROM works JOIN ready USING (work) LEFT JOIN clash ON w = works.work),
orphans AS (SELECT work FROM under WHERE pw IS NULL OR (ps IN ('completed', 'cancelled') AND state NOT IN ('completed', 'cancelled'))),
unsyn AS (SELECT parent, work AS child, CASE WHEN ps IN ('completed', 'cancelled') THEN 'not-listed-by-parent-closure' ELSE 'parent-not-closed' END AS reason FROM under
  WHERE state = 'completed' AND pw IS NOT NULL AND (parent, work) NOT IN (SELECT work, child FROM took))"""

_RULES = """r AS (SELECT DISTINCT p_brand AS component, p_partkey % 4 AS m, p_partkey AS k, p_type AS inv, CASE p_partkey % 4 WHEN 0 THEN 'boundary "' || p_type || '" at s' || (p_partkey % 40) || CASE WHEN p_partkey % 8 = 0 THEN ' via test "t"' ELSE '' END
  WHEN 1 THEN 'parity "' || p_type || '" over s' || (p_partkey % 50) || ' between f and g via test "both"' WHEN 2 THEN 'the file Src/Part' || (p_partkey % 60) || '.ts holds ' || regexp_replace(p_name, '[^A-Za-z0-9]', '_', 'g')
  ELSE 'passes test "S' || (p_partkey % 45) || ' and more"' END AS claim FROM part)"""

_GUARDS = f"""v AS (SELECT {list(_VERBS)} AS v), n AS (SELECT p_partkey AS k, len(v) AS m, v FROM part, v),
c AS (SELECT v[CAST(k % m + 1 AS INTEGER)] || 'P' || (k % 31) AS f, v[CAST((k + 3) % m + 1 AS INTEGER)] || 'P' || (k % 17) AS c, v[CAST((k + 5) % m + 1 AS INTEGER)] || 'P' || (k % 13) AS x, v[CAST((k * 7) % m + 1 AS INTEGER)] || 'P' || (k % 31) AS y FROM n),
calls AS (SELECT name, count(*) AS sites FROM (SELECT c AS name FROM c UNION ALL SELECT x FROM c UNION ALL SELECT y FROM c) GROUP BY name),
declared AS (SELECT f AS name FROM c UNION SELECT c FROM c)"""


def _in_kinds(kinds) -> str:
    return "(" + ", ".join(f"'{k}'" for k in kinds) + ")"


_ADMITTED = " OR ".join(
    f"(relation = '{r}' AND " + ("fk = tk AND fk <> 'person'" if ends == "the same kind" else f"fk IN {_in_kinds(ends)} AND tk IN {_in_kinds(to)}") + ")" for r, ends, to in A.RELATIONS
)

SQL = {
    "work_items": f"""WITH RECURSIVE {_EVENTS} SELECT work, coalesce(arg_max("to", pos) FILTER (WHERE event IN ('transitioned', 'closed') AND NOT ended), 'open') AS state,
        coalesce(arg_max(to_owner, pos) FILTER (WHERE event = 'handed-off' AND NOT ended), 'a') AS owner, arg_max(id, pos) AS "last", count(*) AS steps, arg_max(id, pos) FILTER (WHERE event = 'closed' AND NOT ended) AS closed FROM chain GROUP BY work""",
    "work_problems": f"""WITH RECURSIVE {_EVENTS} SELECT work, NULL AS id, 'openings' AS code FROM openings WHERE n <> 1
        UNION ALL SELECT work, id, 'missing-predecessor' FROM e WHERE event <> 'opened' AND pw IS NULL UNION ALL SELECT work, id, 'foreign-predecessor' FROM e WHERE event <> 'opened' AND pw <> work
        UNION ALL SELECT DISTINCT fork.work, e.previous, 'fork' FROM fork JOIN tree ON tree.work = fork.work AND tree.pos = fork.pos JOIN e ON e.id = tree.id
        UNION ALL SELECT work, id, 'unreachable' FROM e WHERE id NOT IN (SELECT id FROM chain) UNION ALL SELECT work, id, 'after-closure' FROM chain WHERE ended
        UNION ALL SELECT work, id, 'from' FROM chain WHERE NOT ended AND event IN ('transitioned', 'closed') AND "from" <> state UNION ALL SELECT work, id, 'no-op' FROM chain WHERE NOT ended AND event = 'transitioned' AND "from" = "to"
        UNION ALL SELECT work, id, 'move' FROM chain WHERE NOT ended AND event = 'transitioned' AND "from" NOT IN ('open', 'active', 'blocked')
        UNION ALL SELECT work, id, 'owner' FROM chain WHERE NOT ended AND event = 'handed-off' AND from_owner <> keeper UNION ALL SELECT work, id, 'no-op-handoff' FROM chain WHERE NOT ended AND event = 'handed-off' AND from_owner = to_owner""",
    "work_ledger": f"WITH {_LEDGER} SELECT work, readiness, conflicts, obstructed FROM led",
    "work_overlaps": f"WITH {_LEDGER} SELECT * FROM met",
    "work_orphans": f"WITH {_LEDGER} SELECT * FROM orphans",
    "work_unsynthesized": f"WITH {_LEDGER} SELECT * FROM unsyn",
    "executable_synthesis": f"WITH {_LEDGER} SELECT parent, child FROM unsyn WHERE parent NOT IN (SELECT parent FROM works WHERE parent IS NOT NULL AND state NOT IN ('completed', 'cancelled'))",
    "work_stats": f"""WITH {_LEDGER} SELECT 'total' AS measure, count(*) AS n FROM works UNION ALL SELECT 'roots', count(*) FROM works WHERE parent IS NULL UNION ALL SELECT 'dependencies', count(*) FROM needs
        UNION ALL SELECT 'state:' || state, count(*) FROM led GROUP BY state UNION ALL SELECT 'readiness:' || readiness, count(*) FROM led GROUP BY readiness UNION ALL SELECT 'risk:' || risk, count(*) FROM led GROUP BY risk
        UNION ALL SELECT 'graphProblems', count(*) FROM problems UNION ALL SELECT 'scopeOverlaps', count(*) FROM met UNION ALL SELECT 'scopeConflicts', count(*) FROM met WHERE status = 'conflict'
        UNION ALL SELECT 'orphans', count(*) FROM orphans UNION ALL SELECT 'unsynthesizedChildren', count(*) FROM unsyn""",
    "assigned_work": f"""WITH {_LEDGER}, a AS (SELECT *, 's' || (k % 7) AS session, row_number() OVER (PARTITION BY k % 7 ORDER BY work) AS i, count(*) OVER (PARTITION BY k % 7) AS n FROM led WHERE state NOT IN ('completed', 'cancelled'))
        SELECT session, work, state, readiness, CASE WHEN conflicts <> '' AND state <> 'blocked' THEN 'yield ' WHEN readiness = 'ready' THEN 'start ' WHEN state = 'active' AND conflicts = '' THEN 'block finish '
          WHEN state = 'blocked' AND NOT obstructed AND conflicts = '' THEN 'resume ' ELSE '' END || 'handoff' AS moves, greatest(n - 3, 0) AS withheld FROM a WHERE i <= 3""",
    "relation_problems": f"""WITH k AS (SELECT {list((*A.KINDS, "person"))} AS ks, {[*[r for r, _, _ in A.RELATIONS], "causes"]} AS rs),
        l AS (SELECT o_orderkey AS link, ks[CAST(o_orderkey % 7 + 1 AS INTEGER)] AS fk, o_orderkey % 2 AS fi, rs[CAST((o_orderkey // 7) % len(rs) + 1 AS INTEGER)] AS relation, ks[CAST((o_orderkey // 84) % 7 + 1 AS INTEGER)] AS tk, (o_orderkey // 5) % 2 AS ti FROM orders, k)
        SELECT link, relation, CASE WHEN fk = tk AND fi = ti THEN 'self' ELSE 'relation' END AS problem FROM l WHERE (fk = tk AND fi = ti) OR NOT ({_ADMITTED})""",
    "context_tests": r"""WITH pp AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$|/$', '', 'g') AS p FROM pages),
        f AS (SELECT page_id, 'f' || page_id || '/' || p || CASE WHEN page_id % 5 = 0 THEN '.test.ts' WHEN page_id % 11 = 0 THEN '.spec.md' ELSE '.ts' END AS path, CASE WHEN page_id % 3 > 0 THEN page_id % 29 END AS component FROM pp),
        s AS (SELECT * FROM f WHERE page_id % 97 IN (1, 10, 16)),
        c AS (SELECT path, 0 AS r FROM s UNION ALL SELECT f.path, 1 FROM f JOIN s ON s.page_id = f.page_id + 3 UNION ALL SELECT f.path, 2 FROM f JOIN s ON f.page_id = s.page_id + 3 UNION ALL SELECT path, 3 FROM f WHERE component IN (SELECT component FROM s))
        SELECT path, list_extract(['selected', 'direct importer', 'direct import', 'same owning component'], min(r) + 1) AS reason FROM c WHERE (ends_with(path, '.test.ts') OR (regexp_matches(path, '(^|/)(__tests__|test|tests)(/|$)') AND NOT ends_with(path, '.spec.md'))) GROUP BY path""",
    "context_obligations": f"""WITH {_RULES}, s(symbol) AS (VALUES ('s10'), ('s30'), ('s31'))
        SELECT DISTINCT component, claim, CASE m WHEN 0 THEN 'boundary' WHEN 1 THEN 'parity' ELSE 'claim' END AS kind, CASE WHEN m < 2 THEN inv END AS invariant,
          CASE m WHEN 0 THEN 's' || (k % 40) WHEN 1 THEN 'f g' ELSE '' END AS chokepoints, CASE WHEN m = 0 AND k % 8 = 0 THEN 't' WHEN m = 1 THEN 'both' ELSE '' END AS oracles
        FROM r WHERE component = 'Brand#12' OR contains(lower(claim), 'src/part7.ts') OR EXISTS (SELECT 1 FROM s WHERE regexp_matches(lower(claim), '(^|[^a-z0-9_$])' || symbol || '($|[^a-z0-9_$])'))""",
    "context_records": """WITH r AS (SELECT o_orderkey AS id, 'Use Store' || (o_custkey % 300) || ' for it' AS chose, 'see src/Unit' || (o_orderkey % 210) || '.ts: ' || o_orderpriority AS because, o_orderkey % 3 = 0 AS has, o_orderkey % 90 AS f FROM orders),
        m AS (SELECT id, 'file:src/u30.ts' AS m FROM r WHERE has AND f = 30 UNION ALL SELECT id, 'file:src/u7.ts' FROM r WHERE has AND f = 7 UNION ALL SELECT id, 'text:store12' FROM r WHERE regexp_matches(lower(chose), '(^|[^a-z0-9_$])store12($|[^a-z0-9_$])')
          UNION ALL SELECT id, 'text:Unit20.ts' FROM r WHERE contains(lower(because), 'unit20.ts') UNION ALL SELECT id, 'text:urgent' FROM r WHERE regexp_matches(lower(because), '(^|[^a-z0-9_$])urgent($|[^a-z0-9_$])')
          UNION ALL SELECT id, 'text:src/unit7.ts' FROM r WHERE contains(lower(because), 'src/unit7.ts'))
        SELECT id, string_agg(m, ' ' ORDER BY m) AS matched_by FROM m GROUP BY id""",
    "guard_conventions": f"""WITH {_GUARDS} SELECT name, sites, CASE WHEN name IN ('canP2', 'isP1') THEN 'dismissed' WHEN name IN ('hasP7', 'mintP9') THEN 'ANCHORED' WHEN name IN ('gateP3', 'sealP4') THEN 'ORACLE' WHEN sites = 1 THEN 'single' ELSE 'CONVENTION' END AS status
        FROM calls WHERE name IN (SELECT name FROM declared) AND (regexp_matches(name, '{A.GUARD}') OR name = 'helperP5')""",
    "word_expansions": """WITH RECURSIVE c AS (SELECT c_custkey AS k, 'w' || c_custkey AS word, CASE WHEN c_custkey % 10 = 0 THEN 'hello there' ELSE 'a' || (c_custkey % 4) || ' imports b' END AS own,
          CASE WHEN c_custkey % 25 < 24 THEN 'w' || (c_custkey + 1) WHEN (c_custkey // 25) % 3 = 0 THEN 'w' || (c_custkey - 5) WHEN (c_custkey // 25) % 3 = 1 THEN 'gone' END AS nxt FROM customer),
        w AS (SELECT word, word AS at, [word] AS path, 1 AS depth FROM c UNION ALL SELECT w.word, c.nxt, list_append(path, c.nxt), depth + 1 FROM w JOIN c ON c.word = w.at WHERE c.nxt IS NOT NULL AND c.nxt IN (SELECT word FROM c) AND NOT list_contains(path, c.nxt) AND depth < 16)
        SELECT DISTINCT w.word, own AS claim, CAST(depth AS VARCHAR) AS what FROM w JOIN c ON c.word = w.at
        UNION SELECT w.word, NULL, 'no-claim' FROM w JOIN c ON c.word = w.at WHERE own = 'hello there' UNION SELECT w.word, NULL, 'cycle' FROM w JOIN c ON c.word = w.at WHERE list_contains(path, c.nxt)
        UNION SELECT w.word, NULL, 'missing' FROM w JOIN c ON c.word = w.at WHERE c.nxt IS NOT NULL AND c.nxt NOT IN (SELECT word FROM c)
        UNION SELECT w.word, NULL, 'depth' FROM w JOIN c ON c.word = w.at WHERE depth = 16 AND c.nxt IN (SELECT word FROM c) AND NOT list_contains(path, c.nxt)""",
}
