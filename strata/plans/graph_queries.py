"""Path, graph and claim queries over pages, conversations, orders and literal rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import claims as C
from strata.operators import graph as G
from strata.plans import roles as R


def longest_prefix_owner(spark, d):
    """The deepest owning directory of each page; directories one or two deep own."""
    paths = R.page_paths(spark, d)
    dirs = G.directory_tree(paths).where("depth between 1 and 2").select("dir")
    return paths.join(G.longest_prefix(paths.select("path").distinct(), dirs), "path").select("page_id", "dir")


def directory_tree(spark, d):
    return G.directory_tree(R.page_paths(spark, d))


def suffix_unique_match(spark, d):
    paths = R.page_paths(spark, d).select("path").distinct()
    tokens = paths.select(F.substring_index("path", "/", -1).alias("token")).unionByName(paths.select(F.substring_index("path", "/", -2).alias("token")))
    return G.unique_suffix(tokens, paths)


def _scopes(spark, d):
    """Each page is a work on its path; a page of an odd number works on all that lies under it."""
    p = R.page_paths(spark, d)
    return p.select(F.concat(F.lit("w"), F.lpad(F.col("page_id").cast("string"), 12, "0")).alias("work"), F.col("path").alias("base"), (F.col("page_id") % 2 == 1).alias("tree"))


def scope_overlap(spark, d):
    return G.overlaps(_scopes(spark, d))


def _halved(spark, d):
    c = R.table(spark, d, "conversations").select(F.col("conv_id").alias("id")).distinct()
    return c.select("id", F.when(F.col("id") > 0, F.floor(F.col("id") / 2).cast("long")).alias("parent"))


def reverse_reach(spark, d):
    """All conversations under conversation 3 when each hangs under half its number."""
    edges = _halved(spark, d).where("parent is not null").select(F.col("parent").alias("source"), F.col("id").alias("target"))
    return G.reach(edges, spark.range(3, 4).select(F.col("id").alias("node")))


def root_ancestors(spark, d):
    """Customers in chains of 150, each after the one before: the first of its chain and how far away it is."""
    c = R.table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return G.root_of(c.select("id", F.when(F.col("id") % 150 != 0, F.col("id") - 1).alias("parent")))


def cycles(spark, d):
    """Customers in nines: of every second nine a ring, and in every third a step back from the sixth to the third."""
    c = R.table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    k, nine = (F.col("id") - 1) % 9, F.floor((F.col("id") - 1) / 9)
    on = c.select(F.col("id").alias("source"), F.when(k < 8, F.col("id") + 1).when(nine % 2 == 0, F.col("id") - 8).alias("target"))
    back = c.where((k == 5) & (nine % 3 == 0)).select(F.col("id").alias("source"), (F.col("id") - 3).alias("target"))
    return G.cycles(on.where("target is not null").unionByName(back)).select(F.array_join(F.transform("cycle", lambda x: x.cast("string")), ">").alias("cycle"))


def works(spark, d):
    """Orders as pieces of work: (works, needs, synthesized, scopes)."""
    o = R.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    t = lambda c: c.cast("string")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("k") % n + 1).cast("int"))
    w = o.select(
        t(F.col("k")).alias("work"), pick(("open", "completed", "blocked", "cancelled", "active", "open", "completed"), 7).alias("state"),
        t(F.when(F.col("k") % 50 == 0, -F.col("k")).when(F.col("k") % 5 == 1, F.floor(F.col("k") / 4))).alias("parent"), pick(("low", "medium", "high", "critical"), 4).alias("risk"),
    )
    needs = o.select(t(F.col("k")).alias("work"), F.explode(F.array(t(F.floor(F.col("k") / 3)), t(F.col("k") - F.col("k") % 4))).alias("dependency")).distinct()
    took = o.where("k % 15 in (1, 2)").select(t(F.floor(F.col("k") / 4)).alias("work"), t(F.col("k")).alias("child"))
    folder = F.concat(F.lit("d"), t(F.col("k") % 397))
    scopes = o.select(t(F.col("k")).alias("work"), F.when(F.col("k") % 31 == 0, folder).otherwise(F.concat(folder, F.lit("/f"), t(F.col("k") % 5))).alias("base"), (F.col("k") % 31 == 0).alias("tree"))
    return w, needs, took, scopes


def graph_problems(spark, d):
    w, needs, took, _ = works(spark, d)
    return G.graph_problems(w, needs, took)


def work_readiness(spark, d):
    w, needs, took, _ = works(spark, d)
    return G.readiness(w, needs, G.graph_problems(w, needs, took))


def component_dependencies(spark, d):
    owner = R.files(spark, d).select(F.col("path").alias("id"), "component")
    return G.component_links(R.imports(spark, d), owner)


def crossing_owners(spark, d):
    p = R.table(spark, d, "part")
    return G.unique_owner(p.select(F.concat_ws("/", "p_name", (F.col("p_size") % 9).cast("string")).alias("symbol"), F.col("p_brand").alias("component")))


def _crossings(spark, d):
    """Regions lead to the nations of theirs, and along a chain by name."""
    n, r = R.table(spark, d, "nation"), R.table(spark, d, "region")
    down = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("from"), F.col("n_name").alias("to"), (F.col("n_nationkey") / 10.0).alias("heat"))
    names = r.select("r_name", "r_regionkey")
    on = names.alias("x").join(names.alias("y"), F.expr("y.r_regionkey = x.r_regionkey + 1")).select(F.col("x.r_name").alias("from"), F.col("y.r_name").alias("to"), F.lit(1.0).alias("heat"))
    suppliers = R.table(spark, d, "supplier").select(F.col("s_suppkey").alias("i"))
    tier = lambda n: F.concat(F.lit("tier "), F.lpad(n.cast("string"), 9, "0"))
    chain = suppliers.select(tier(F.col("i")).alias("from"), tier(F.col("i") + 1).alias("to"), (F.col("i") / 4.0).alias("heat"))
    skip = names.alias("x").join(names.alias("y"), F.expr("y.r_regionkey = x.r_regionkey + 2")).select(F.col("x.r_name").alias("from"), F.col("y.r_name").alias("to"), F.lit(5.0).alias("heat"))
    return down.unionByName(on).unionByName(skip).unionByName(chain)


def longest_spine(spark, d):
    return G.longest_spine(_crossings(spark, d))


def crossing_classes(spark, d):
    rows = _crossings(spark, d)
    return G.classify_crossings(rows, G.longest_spine(rows)).select("from", "to", "class")


def interleaved_top(spark, d):
    """Dearest orders, one of each status in turn."""
    o = R.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", (-F.col("o_totalprice")).alias("cost"))
    return G.interleave(o, "o_orderstatus", "cost", "o_orderkey").orderBy("turn", "_lane").limit(20).select("o_orderkey", "o_orderstatus", "turn")


def capped_with_withheld(spark, d):
    return C.capped(R.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 24, F.desc("o_totalprice"), "o_orderkey")


#: Claims of every form, and near misses.
CLAIMS = (
    'boundary "no leak" at gate', 'boundary "no leak" at gate via test "gate holds"', 'boundary "x y" at a.b crossing web -> store via guard "lint"', 'boundary "x y" at a.b crossing web -> store',
    'boundary "broken at gate', 'parity "same" over Verdict between render and parse via test "both sides"', 'parity "same" over Verdict between render and parse', 'passes test "all good"',
    "README.md exists at root", "x.ts exists at this node", "x.ts exists at nowhere", "a.ts imports b", "https://h/x responds 200", 'https://h/x responds 503 with "down"', "lives in core",
    "conforms to Ledger", "typechecks", "plain words", "",
)


def _claims(spark, d):
    given = spark.createDataFrame([(i, c) for i, c in enumerate(CLAIMS)], "ord long, claim string")
    texts = R.table(spark, d, "benchmark").select((F.col("item_id") + 100).alias("ord"), F.concat(F.lit('passes test "'), F.regexp_replace("text", '["\n]', ""), F.lit('"')).alias("claim"))
    return given.unionByName(texts)


def claim_grammar(spark, d):
    c = F.col("claim")
    return _claims(spark, d).select("ord", C.form(c).alias("form"), C.boundary(c).alias("b"), C.parity(c).alias("p"), C.normalized(c).alias("normalized"), C.never_red_rank(c).alias("rank")).select(
        "ord", "form", "b.inv", "b.chokepoint", "b.crossing_from", "b.crossing_to", "b.verb", "b.oracle", F.col("p.domain").alias("domain"), F.col("p.f").alias("f"), F.col("p.g").alias("g"), "normalized", "rank"
    )


def _records(spark, d):
    o = R.table(spark, d, "orders")
    kinds = F.array(*[F.lit(x) for x in ("pass", "pass", "fail", "skip", "pass")])
    return o.where("o_orderpriority <> '5-LOW'").select(
        (F.col("o_custkey") % 30).cast("string").alias("node"), F.col("o_orderkey").cast("string").alias("claim"), F.element_at(kinds, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("kind"),
        F.when(F.col("o_orderkey") % 2 == 0, "h1").otherwise("h0").alias("commit"), (F.col("o_orderkey") % 9).cast("int").alias("runs"), (F.col("o_orderkey") % 4 == 0).alias("ever_failed"),
    )


def panel_lights(spark, d):
    claims = R.table(spark, d, "orders").select((F.col("o_custkey") % 30).cast("string").alias("component"), F.col("o_orderkey").cast("string").alias("claim"))
    return C.panel(claims, _records(spark, d), "h1")


def gate_grades(spark, d):
    r = _records(spark, d).withColumn("verb", F.element_at(F.array(F.lit("test"), F.lit("guard"), F.lit("")), (F.col("claim").cast("long") % 3 + 1).cast("int")))
    gates = r.select(F.col("node").alias("component"), C.grade(F.col("verb"), F.col("kind"), F.col("commit"), F.lit("h1")).alias("grade"), (F.col("kind") == "fail").alias("failed"))
    return C.gate_summary(gates)


def never_red(spark, d):
    r = _records(spark, d)
    return C.never_red(r, r.where("runs = 5").select("node", "claim")).select("node", "claim", "runs", "rank")


def holding_cost(spark, d):
    costs = R.table(spark, d, "events").groupBy(F.col("event_type").alias("claim")).agg(F.max("value").alias("ms"))
    return C.holding_cost(costs, total_floor=200.0, claim_floor=90.0)


def oracle_resolution(spark, d):
    results = R.table(spark, d, "part").select(F.concat_ws(" > ", "p_brand", "p_type", "p_name").alias("full_name"), F.when(F.col("p_size") == 1, "failed").when(F.col("p_size") < 10, "skipped").otherwise("passed").alias("status"), F.col("p_size").cast("double").alias("duration"))
    names = R.table(spark, d, "part").select(F.substring_index("p_type", " ", -1).alias("name")).distinct().unionByName(spark.createDataFrame([("no such test",), ("Brand#11",)], "name string"))
    return C.oracle_results(names, results)


def regulation(spark, d):
    """The one action for what twelve groups of customers show."""
    o = R.table(spark, d, "orders")
    seen = o.groupBy(F.concat(F.lit("r"), F.col("o_custkey") % 12).alias("rule")).agg(F.min("o_orderkey").cast("string").alias("key"), F.max("o_orderkey").alias("m"))
    obs = seen.select("rule", "key", F.element_at(F.array(F.lit("release"), F.lit("redirect"), F.lit("require-decision")), (F.col("m") % 3 + 1).cast("int")).alias("action"))
    rules = spark.range(12).select(F.concat(F.lit("r"), "id").alias("rule"), F.col("id").cast("int").alias("ord"))
    return C.select_action(obs, rules)


def next_action(spark, d):
    o = R.table(spark, d, "orders")
    n = lambda k, m: F.greatest(F.lit(0), F.count_if(F.col("o_orderkey") % k == 0) - m)
    reading = o.groupBy((F.col("o_custkey") % 64).alias("g")).agg(
        F.lit(0).alias("damaged_sources"), n(97, 4).alias("graph_problems"), n(41, 7).alias("conflicts"), n(43, 6).alias("dangling"), n(31, 9).alias("blocked"), n(29, 9).alias("synthesizable"),
        n(23, 11).alias("ready"), n(17, 15).alias("active"), n(13, 20).alias("unverified"), F.when(F.max("o_orderkey") % 2 == 0, "stale").otherwise("current").alias("verification"),
    )
    return C.next_action(reading).select("g", "action")


QUERIES = {
    f.__name__: f
    for f in (
        longest_prefix_owner, directory_tree, suffix_unique_match, scope_overlap, reverse_reach, root_ancestors, cycles, work_readiness, graph_problems, component_dependencies,
        crossing_owners, longest_spine, crossing_classes, interleaved_top, capped_with_withheld, claim_grammar, panel_lights, gate_grades, never_red, holding_cost, oracle_resolution,
        regulation, next_action,
    )
}

_PATHS = r"pp AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$|/$', '', 'g') AS path FROM pages)"
_TREE = f"""{_PATHS}, parts AS (SELECT DISTINCT path, string_split(path, '/') AS s FROM pp),
tree AS (SELECT DISTINCT array_to_string(s[1:i], '/') AS dir, i AS depth FROM (SELECT s, unnest(range(0, len(s))) AS i FROM parts))"""
WORKS = """works AS (SELECT CAST(o_orderkey AS VARCHAR) AS work, o_orderkey AS k, list_extract(['open', 'completed', 'blocked', 'cancelled', 'active', 'open', 'completed'], CAST(o_orderkey % 7 + 1 AS INTEGER)) AS state,
  CAST(CASE WHEN o_orderkey % 50 = 0 THEN -o_orderkey WHEN o_orderkey % 5 = 1 THEN o_orderkey // 4 END AS VARCHAR) AS parent, list_extract(['low', 'medium', 'high', 'critical'], CAST(o_orderkey % 4 + 1 AS INTEGER)) AS risk FROM orders),
needs AS (SELECT CAST(o_orderkey AS VARCHAR) AS work, CAST(o_orderkey // 3 AS VARCHAR) AS dependency FROM orders UNION SELECT CAST(o_orderkey AS VARCHAR), CAST(o_orderkey - o_orderkey % 4 AS VARCHAR) FROM orders),
took AS (SELECT CAST(o_orderkey // 4 AS VARCHAR) AS work, CAST(o_orderkey AS VARCHAR) AS child FROM orders WHERE o_orderkey % 15 IN (1, 2)),
under AS (SELECT w.*, p.work AS pw, p.state AS ps FROM works w LEFT JOIN works p ON p.work = w.parent WHERE w.parent IS NOT NULL),
need AS (SELECT n.*, w.state, o.state AS os FROM needs n JOIN works w USING (work) LEFT JOIN works o ON o.work = n.dependency),
problems AS (
  SELECT work, 'missing-parent' AS problem, parent AS related FROM under WHERE pw IS NULL
  UNION SELECT work, 'terminal-parent', parent FROM under WHERE ps IN ('completed', 'cancelled') AND state NOT IN ('completed', 'cancelled')
  UNION SELECT work, 'missing-dependency', dependency FROM need WHERE os IS NULL
  UNION SELECT work, 'dependency-order', dependency FROM need WHERE state IN ('active', 'completed') AND os <> 'completed'
  UNION SELECT t.work, 'invalid-synthesis', t.child FROM took t LEFT JOIN works c ON c.work = t.child WHERE c.work IS NULL OR c.parent IS DISTINCT FROM t.work OR c.state <> 'completed'
  UNION SELECT c.parent, 'missing-synthesis', c.work FROM works c JOIN works p ON p.work = c.parent AND p.state IN ('completed', 'cancelled') WHERE c.state = 'completed' AND (c.parent, c.work) NOT IN (SELECT work, child FROM took)
  UNION SELECT work, 'dependency-cycle', work FROM needs WHERE work = dependency UNION SELECT work, 'parent-cycle', work FROM works WHERE work = parent),
ready AS (SELECT works.work, CASE WHEN state IN ('completed', 'cancelled') THEN 'done' WHEN state = 'active' THEN 'active' WHEN state = 'blocked' THEN 'blocked' WHEN works.work IN (SELECT work FROM problems) OR coalesce(stuck, false) THEN 'blocked'
    WHEN coalesce(open, false) THEN 'waiting' ELSE 'ready' END AS readiness FROM works
  LEFT JOIN (SELECT work, bool_or(os IN ('blocked', 'cancelled')) AS stuck, bool_or(os NOT IN ('blocked', 'cancelled', 'completed')) AS open FROM need WHERE os IS NOT NULL GROUP BY work) m ON m.work = works.work)"""
_CROSS = """cr AS (SELECT r_name AS f, n_name AS t, n_nationkey / 10.0::DOUBLE AS h FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT x.r_name, y.r_name, 1.0 FROM region x JOIN region y ON y.r_regionkey = x.r_regionkey + 1 UNION ALL SELECT x.r_name, y.r_name, 5.0 FROM region x JOIN region y ON y.r_regionkey = x.r_regionkey + 2
 UNION ALL SELECT 'tier ' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0'), 'tier ' || lpad(CAST(s_suppkey + 1 AS VARCHAR), 9, '0'), s_suppkey / 4.0::DOUBLE FROM supplier),
steps AS (SELECT f, t, sum(h) AS h FROM cr GROUP BY f, t),
walk AS (SELECT DISTINCT [f] AS path, 0.0::DOUBLE AS heat FROM steps WHERE f NOT IN (SELECT t FROM steps)
 UNION ALL SELECT list_append(path, t), heat + h FROM walk JOIN steps ON f = path[len(path)] WHERE t IN (SELECT f FROM steps) AND NOT list_contains(path, t)),
best AS (SELECT path FROM walk ORDER BY len(path) DESC, heat DESC, path LIMIT 1),
spine AS (SELECT unnest(path) AS region, CAST(generate_subscripts(path, 1) - 1 AS INTEGER) AS pos FROM best)"""
_RECORDS = """rec AS (SELECT CAST(o_custkey % 30 AS VARCHAR) AS node, CAST(o_orderkey AS VARCHAR) AS claim, list_extract(['pass', 'pass', 'fail', 'skip', 'pass'], CAST(o_orderkey % 5 + 1 AS INTEGER)) AS kind,
 CASE WHEN o_orderkey % 2 = 0 THEN 'h1' ELSE 'h0' END AS commit, CAST(o_orderkey % 9 AS INTEGER) AS runs, o_orderkey % 4 = 0 AS ever_failed, o_orderkey FROM orders WHERE o_orderpriority <> '5-LOW')"""

_FORMS = " ".join(f"WHEN regexp_matches(claim, '{regex}') THEN '{name}'" for name, regex in C.FORMS)


def _part(regex: str, i: int) -> str:
    return f"nullif(regexp_extract(claim, '{regex}', {i}), '')"


_GIVEN = ", ".join("({}, '{}')".format(i, c.replace("'", "''")) for i, c in enumerate(CLAIMS))

SQL = {
    "longest_prefix_owner": f"""WITH {_TREE}, dirs AS (SELECT dir FROM tree WHERE depth BETWEEN 1 AND 2),
        up AS (SELECT path, array_to_string(s[1:i], '/') AS dir FROM (SELECT path, s, unnest(range(0, len(s) + 1)) AS i FROM parts)),
        best AS (SELECT path, arg_max(dir, length(dir)) AS dir FROM up SEMI JOIN dirs USING (dir) GROUP BY path) SELECT page_id, dir FROM pp LEFT JOIN best USING (path)""",
    "directory_tree": f"WITH {_TREE} SELECT dir, CAST(depth AS INTEGER) AS depth FROM tree",
    "suffix_unique_match": f"""WITH {_PATHS}, parts AS (SELECT DISTINCT path, string_split(path, '/') AS s FROM pp),
        tok AS (SELECT s[len(s)] AS token FROM parts UNION SELECT array_to_string(s[greatest(len(s) - 1, 1):], '/') FROM parts)
        SELECT token, min(path) AS path FROM tok JOIN parts ON path = token OR ends_with(path, '/' || token) GROUP BY token HAVING count(*) = 1""",
    "scope_overlap": f"""WITH {_PATHS}, s AS (SELECT 'w' || lpad(CAST(page_id AS VARCHAR), 12, '0') AS work, path AS base, page_id % 2 = 1 AS tree FROM pp)
        SELECT a.work AS "left", b.work AS "right" FROM s a JOIN s b ON a.work < b.work AND (a.base = b.base OR (a.tree AND starts_with(b.base, a.base || '/')) OR (b.tree AND starts_with(a.base, b.base || '/')))""",
    "reverse_reach": """WITH RECURSIVE c AS (SELECT DISTINCT conv_id FROM conversations), r AS (SELECT 3::BIGINT AS node UNION SELECT c.conv_id FROM r JOIN c ON c.conv_id // 2 = r.node AND c.conv_id > 0) SELECT node FROM r""",
    "root_ancestors": "SELECT c_custkey AS id, c_custkey - c_custkey % 150 AS root, c_custkey % 150 AS hops FROM customer",
    "cycles": """WITH RECURSIVE e AS (SELECT c_custkey AS s, CASE WHEN (c_custkey - 1) % 9 < 8 THEN c_custkey + 1 WHEN ((c_custkey - 1) // 9) % 2 = 0 THEN c_custkey - 8 END AS t FROM customer
          UNION ALL SELECT c_custkey, c_custkey - 3 FROM customer WHERE (c_custkey - 1) % 9 = 5 AND ((c_custkey - 1) // 9) % 3 = 0),
        w AS (SELECT [s, t] AS p FROM e WHERE s < t UNION ALL SELECT list_append(p, t) FROM w JOIN e ON s = p[len(p)] WHERE t > p[1] AND NOT list_contains(p, t))
        SELECT DISTINCT array_to_string(p, '>') AS cycle FROM w JOIN e ON s = p[len(p)] AND t = p[1]""",
    "work_readiness": f"WITH {WORKS} SELECT work, readiness FROM ready",
    "graph_problems": f"WITH {WORKS} SELECT * FROM problems",
    "component_dependencies": """WITH e AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) SELECT DISTINCT 'n:' || s_nationkey AS source, p_brand AS target FROM e JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey""",
    "crossing_owners": "SELECT p_name || '/' || (p_size % 9) AS symbol, min(p_brand) AS component FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) = 1",
    "longest_spine": f"WITH RECURSIVE {_CROSS} SELECT pos, region, true AS complete FROM spine",
    "crossing_classes": f"""WITH RECURSIVE {_CROSS} SELECT f AS "from", t AS "to", CASE WHEN f NOT IN (SELECT t FROM steps) AND coalesce(i.pos, -1) <> 0 THEN 'supply' WHEN coalesce(j.pos > i.pos, false) THEN 'promotion' WHEN i.pos IS NOT NULL AND j.pos IS NULL THEN 'reach' ELSE 'aside' END AS class
        FROM cr LEFT JOIN spine i ON i.region = f LEFT JOIN spine j ON j.region = t""",
    "interleaved_top": """WITH r AS (SELECT o_orderkey, o_orderstatus, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS turn, max(o_totalprice) OVER (PARTITION BY o_orderstatus) AS lane FROM orders)
        SELECT o_orderkey, o_orderstatus, turn FROM r ORDER BY turn, lane DESC LIMIT 20""",
    "capped_with_withheld": "SELECT o_orderkey, o_totalprice, greatest((SELECT count(*) FROM orders) - 24, 0) AS withheld FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 24",
    "claim_grammar": f"""WITH c(ord, claim) AS (SELECT * FROM (VALUES {_GIVEN}) UNION ALL SELECT item_id + 100, 'passes test "' || regexp_replace(text, '["\n]', '', 'g') || '"' FROM benchmark)
        SELECT CAST(ord AS BIGINT) AS ord, CASE {_FORMS} END AS form, {_part(C.BOUNDARY, 1)} AS inv, {_part(C.BOUNDARY, 2)} AS chokepoint, {_part(C.BOUNDARY, 3)} AS crossing_from, {_part(C.BOUNDARY, 4)} AS crossing_to,
               {_part(C.BOUNDARY, 5)} AS verb, {_part(C.BOUNDARY, 6)} AS oracle, {_part(C.PARITY, 2)} AS domain, {_part(C.PARITY, 3)} AS f, {_part(C.PARITY, 4)} AS g,
               CASE WHEN regexp_matches(claim, '{C.BOUNDARY}') THEN regexp_replace(claim, '\\s+crossing\\s+\\S+\\s+->\\s+\\S+', '') ELSE claim END AS normalized,
               CASE WHEN regexp_matches(claim, '\\svia\\s+(test|guard)\\s+"|^passes test\\s+"|^conforms to\\s+') THEN 3 WHEN regexp_matches(claim, '^boundary\\s+"') THEN 2 WHEN regexp_matches(claim, '^\\S+\\s+(exists at|imports)\\b') THEN 0 ELSE 1 END AS rank FROM c""",
    "panel_lights": f"""WITH {_RECORDS}, l AS (SELECT CAST(o_custkey % 30 AS VARCHAR) AS component, CASE WHEN kind IS NULL THEN 'none' WHEN kind = 'pass' AND commit <> 'h1' THEN 'stale' ELSE kind END AS light FROM orders o LEFT JOIN rec ON rec.o_orderkey = o.o_orderkey)
        SELECT component, count(*) AS total, count(*) FILTER (WHERE light = 'pass') AS pass, count(*) FILTER (WHERE light = 'fail') AS fail, count(*) FILTER (WHERE light = 'stale') AS stale, count(*) FILTER (WHERE light = 'skip') AS skip, count(*) FILTER (WHERE light = 'none') AS none FROM l GROUP BY component""",
    "gate_grades": f"""WITH {_RECORDS}, g AS (SELECT node AS component, kind = 'fail' AS failed, CASE WHEN kind = 'skip' THEN 'U' WHEN o_orderkey % 3 = 0 THEN CASE WHEN kind <> 'pass' THEN 'D' WHEN commit <> 'h1' THEN 'B' ELSE 'A' END WHEN o_orderkey % 3 = 1 AND kind = 'pass' THEN 'C' ELSE 'D' END AS grade FROM rec),
        n AS (SELECT component, grade, count(*) AS n FROM g GROUP BY 1, 2), m AS (SELECT component, grade AS modal FROM n QUALIFY row_number() OVER (PARTITION BY component ORDER BY n DESC, grade) = 1)
        SELECT component, modal, count(*) FILTER (WHERE failed OR grade > modal) AS exceptions FROM g JOIN m USING (component) GROUP BY 1, 2""",
    "never_red": f"WITH {_RECORDS} SELECT node, claim, runs, 1 AS rank FROM rec WHERE kind = 'pass' AND runs >= 3 AND NOT ever_failed AND runs <> 5",
    "holding_cost": """WITH c AS (SELECT event_type AS claim, max(value) AS ms FROM events GROUP BY 1), t AS (SELECT sum(ms) AS total_ms, max(ms) AS most FROM c)
        SELECT claim, ms, total_ms, total_ms >= 200 OR most >= 90 AS loud, ms >= greatest(200.0, 0.25 * total_ms) AS finding FROM c, t ORDER BY ms DESC, claim LIMIT 5""",
    "oracle_resolution": """WITH r AS (SELECT p_brand || ' > ' || p_type || ' > ' || p_name AS full_name, CASE WHEN p_size = 1 THEN 'failed' WHEN p_size < 10 THEN 'skipped' ELSE 'passed' END AS status, CAST(p_size AS DOUBLE) AS duration FROM part),
        n AS (SELECT DISTINCT list_extract(string_split(p_type, ' '), -1) AS name FROM part UNION SELECT 'no such test' UNION SELECT 'Brand#11')
        SELECT name, CASE WHEN count(full_name) = 0 THEN 'vanished' WHEN count(*) FILTER (WHERE status = 'failed') > 0 THEN 'fail' WHEN count(*) FILTER (WHERE status = 'passed') = 0 THEN 'none-ran' ELSE 'pass' END AS verdict, sum(duration) AS ms
        FROM n LEFT JOIN r ON contains(full_name, name) GROUP BY name""",
    "regulation": """WITH s AS (SELECT o_custkey % 12 AS r, CAST(min(o_orderkey) AS VARCHAR) AS key, CAST(max(o_orderkey) % 3 AS INTEGER) AS m FROM orders GROUP BY 1)
        SELECT CASE m WHEN 2 THEN 'require-decision' ELSE 'redirect' END AS action, 'r' || r AS rule, key FROM s WHERE m > 0 ORDER BY m DESC, r LIMIT 1""",
    "next_action": """WITH n AS (SELECT o_custkey % 64 AS g, count(*) FILTER (WHERE o_orderkey % 97 = 0) - 4 AS a, count(*) FILTER (WHERE o_orderkey % 41 = 0) - 7 AS b, count(*) FILTER (WHERE o_orderkey % 43 = 0) - 6 AS c, count(*) FILTER (WHERE o_orderkey % 31 = 0) - 9 AS d,
          count(*) FILTER (WHERE o_orderkey % 29 = 0) - 9 AS e, count(*) FILTER (WHERE o_orderkey % 23 = 0) - 11 AS f, count(*) FILTER (WHERE o_orderkey % 17 = 0) - 15 AS h, count(*) FILTER (WHERE o_orderkey % 13 = 0) - 20 AS i, max(o_orderkey) % 2 = 0 AS stale FROM orders GROUP BY 1)
        SELECT g, CASE WHEN a > 0 THEN 'refuse' WHEN b > 0 THEN 'resolve-conflict' WHEN c > 0 THEN 'repair-navigation' WHEN d > 0 THEN 'unblock' WHEN e > 0 THEN 'synthesize' WHEN f > 0 THEN 'dispatch' WHEN h > 0 THEN 'continue' WHEN i > 0 OR stale THEN 'verify' ELSE 'steady' END AS action FROM n""",
}
