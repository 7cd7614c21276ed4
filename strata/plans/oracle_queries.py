"""Queries over test files that are made from the driver's tables: what tests range over, which titles
there are now and were before, and claims that need what was measured elsewhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators import claims as K
from strata.plans import roles as R
from strata.sources import extractors as E
from strata.sources import jsonl, strict
from strata.sources import oracles as O
from strata.sources.shared import folder

#: Loops of a test, by the part's key modulo their number: TypeScript, then Python.
LOOPS = (
    "for (const x of REG) { expect(f@(x)).toBe(g(x)); }",
    "expect(REG.length).toBeGreaterThanOrEqual(3); Object.keys(REG).forEach((x) => f@(g, x));",
    "LIST.map((x) => x).filter(Boolean).forEach((x) => f@(x)); // REG.map(g)",
    "['a', 'b'].forEach((x) => f@(x));",
    "expect(/for (const x of REG)/.test('REG.map(g)')).toBe(`${f@}` );",
    "it.each(REG)('case', (x) => f@(x)); for (const y of ['a']) { g(y); }",
    "for (const x of rows()) { f@(x); g(x); }",
)
PYTHON = ("assert len(REG) >= 3\n    for x in sorted(REG):\n        f@(x), g(x)", "for x in ['a', 'b']:\n        f@(x)", "assert f@(REG)")


def _t(c):
    return c.cast("string")


def _tests(spark, d):
    """Parts as test files: a described block in TypeScript, or a function in Python."""
    k = F.col("p_partkey")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
    script = F.concat(F.lit("import { REG } from './reg';\nconst LIST = ['a', 'b'] as const;\ndescribe('covers "), _t(k), F.lit("', () => {\n  "), F.replace(pick(LOOPS), F.lit("@"), _t(k)), F.lit("\n});\n"))
    python = F.concat(F.lit("from m import REG\n\ndef test_covers_"), _t(k), F.lit("():\n    "), F.replace(pick(PYTHON), F.lit("@"), _t(k)), F.lit("\n\nx = 1\n"))
    is_python = k % 4 == 3
    path = F.when(is_python, F.concat(F.lit("t/test_p"), _t(k), F.lit(".py"))).otherwise(F.concat(F.lit("t/p"), _t(k), F.lit(".test.ts")))
    return R.table(spark, d, "part").select(k.alias("k"), path.alias("path"), F.when(is_python, python).otherwise(script).alias("text"))


def _named(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 11 == 0, "no such test").when(k % 4 == 3, F.concat(F.lit("test_covers_"), _t(k))).otherwise(F.concat(F.lit("covers "), _t(k)))
    return R.table(spark, d, "part").select(k.alias("k"), name.alias("name"))


def oracle_domains(spark, d):
    """What the test that each part's claim names ranges over."""
    return O.oracle_domains(_named(spark, d), O.anchors(_tests(spark, d)))


def parity_oracles(spark, d):
    """Whether the test that each part's claim names ranges over REG and drives both projections."""
    claims = _named(spark, d).withColumns({"domain": F.lit("REG"), "f": F.concat(F.lit("f"), _t(F.col("k"))), "g": F.lit("g")})
    return O.parity_oracles(claims, O.anchors(_tests(spark, d))).select("k", "name", "path", "verdict")


def _snapshots(spark, d):
    """Customers as test files at two refs: as they were, renamed, computed or gone."""
    k = F.col("c_custkey")
    c = R.table(spark, d, "customer").select(k.alias("k"), F.concat(F.lit("c"), _t(k), F.lit(".test.ts")).alias("path"))
    k = F.col("k")
    text = lambda title: F.concat(F.lit("describe('c', () => {\n  it("), title, F.lit(", () => {});\n});\nexport const e"), _t(k), F.lit(" = 1;\n"))
    plain = F.concat(F.lit("'does <"), _t(k), F.lit(">'"))
    then = c.select(F.lit("head").alias("ref"), "path", text(plain).alias("text"))
    changed = F.when(k % 5 == 1, F.concat(F.lit("'did <"), _t(k), F.lit(">'"))).when(k % 5 == 2, F.concat(F.lit("name("), plain, F.lit(")"))).otherwise(plain)
    return then.unionByName(c.where("k % 5 <> 3").select(F.lit("now").alias("ref"), "path", text(changed).alias("text")))


def prior_owners(spark, d):
    """Titles at one ref that are lost at the other."""
    s = _snapshots(spark, d)
    return O.prior_owners(O.at_ref(s, "head"), O.at_ref(s, "now"))


def static_resolution(spark, d):
    """Whether the sources declare each customer's test, and some that there never were."""
    s = _snapshots(spark, d)
    now = O.at_ref(s, "now")
    k = F.col("c_custkey")
    names = R.table(spark, d, "customer").select(F.explode(F.array(F.concat(F.lit("does <"), _t(k), F.lit(">")), F.concat(F.lit("never <"), _t(k), F.lit(">")))).alias("name"))
    return O.static_resolution(names, O.titles(now), O.prior_owners(O.at_ref(s, "head"), now))


def facts_at_refs(spark, d):
    """Exports and titles of the code at each of two refs."""
    s = _snapshots(spark, d)
    at = lambda ref: E.facts(O.at_ref(s, ref)).groupBy("fact").agg(F.count("*").alias("n"), F.count_distinct("name").alias("names")).withColumn("ref", F.lit(ref))
    return at("head").unionByName(at("now"))


def external_claims(spark, d):
    """Claims about what URLs respond and whether the code typechecks, against what was measured."""
    k = F.col("o_orderkey")
    o = R.table(spark, d, "orders").select(k.alias("k"), F.concat(F.lit("http://h/"), _t(k)).alias("url"))
    k = F.col("k")
    claims = o.select(F.concat("url", F.lit(" responds "), F.when(k % 7 == 0, "404").otherwise("200"), F.when(k % 3 == 0, F.concat(F.lit(' with "ok '), _t(k % 10), F.lit('"'))).otherwise("")).alias("claim"))
    answers = o.where("k % 5 <> 0").select("url", F.when(k % 14 == 0, 404).otherwise(200).alias("status"), F.concat(F.lit("<b>ok "), _t(k % 20), F.lit("</b>")).alias("body"))
    checks = spark.createDataFrame([("typechecks",)], "claim string")
    return K.responds(claims, answers).unionByName(K.typechecks(checks, o.select((F.col("k") % 9 != 0).alias("passed"))))


def regulation_readings(spark, d):
    """Orders as readings of a project, against the rules."""
    k = F.col("o_orderkey")
    n = lambda m: F.when(k % m == 0, (k % 3 + 1).cast("int"))
    signals = F.element_at(F.array(F.lit("quiet"), F.lit("anchored"), F.lit("needs-decision"), F.lit(None).cast("string")), (k % 4 + 1).cast("int"))
    readings = R.table(spark, d, "orders").select(
        k.alias("k"), (k % 7 > 0).alias("control_readable"), (k % 11 > 0).alias("target_present"), (k % 13 > 0).alias("control_present"), signals.alias("signal"),
        F.when(k % 17 > 0, (k % 19 == 0).cast("int")).alias("damaged_sources"), n(23).alias("graph_problems"), n(29).alias("conflicts"), n(31).alias("unsynthesized"),
        n(37).alias("contested"), n(41).alias("unratified"), n(43).alias("dangling"), n(5).alias("unverified"),
    )
    return K.observe_regulation(readings, "k")


_DEFECT = '{"agent":"a","at":"2024-01-02T03:04:05.678Z","basis":"agent-assessed","event":"recorded","evidence":"seen %s","files":["f%s.ts"],%s"job":"j","repo":{"branch":null,"commit":null,"dirty":null},"session":"%s","summary":"%s","version":1}'


def _defects(spark, d, sound):
    k = F.col("c_custkey")
    session = F.concat(F.lit("s"), _t(k % 4))
    said = F.lit("it broke") if sound else F.when(k % 14 == 3, " padded ").otherwise("it broke")
    body = lambda ident: F.format_string(_DEFECT, _t(k), _t(k % 9), ident, session, said)
    ident = F.concat(F.lit("def-"), F.substring(F.sha2(body(F.lit("")), 256), 1, 12))
    line = body(F.concat(F.lit('"id":"'), ident if sound else F.when(k % 21 == 5, "def-000000000000").otherwise(ident), F.lit('",')))
    return R.table(spark, d, "customer").select(session.alias("session"), (line if sound else F.when(k % 33 == 1, "{").otherwise(line)).alias("value"))


def defects_trusted(spark, d):
    """Defects in ledgers of four sessions, first sound, then with damaged lines: all or none."""
    out = []
    for name in ("sound", "damaged"):
        path = folder(spark, "defects")
        _defects(spark, d, name == "sound").repartition("session").write.partitionBy("session").text(path)
        rows = jsonl.lines(spark, path)
        rows = rows.withColumn("file", F.regexp_replace("file", r"/session=([^/]+)/[^/]+$", "/$1"))  # sessions are folders here
        kept, damage = strict.strict(rows, "defect", F.col("session"))
        out += [kept.agg(F.count("*").alias("n")).select(F.lit(f"{name}:rows").alias("what"), "n"), damage.groupBy(F.concat(F.lit(f"{name}:"), F.col("code")).alias("what")).agg(F.count("*").alias("n"))]
    return reduce(DataFrame.unionByName, out)


QUERIES = {f.__name__: f for f in (oracle_domains, parity_oracles, prior_owners, static_resolution, facts_at_refs, external_claims, regulation_readings, defects_trusted)}

_NAMED = """n AS (SELECT p_partkey AS k, p_partkey % 4 = 3 AS py, p_partkey % 7 AS s, p_partkey % 3 AS p, p_partkey % 11 = 0 AS none,
  CASE WHEN p_partkey % 11 = 0 THEN 'no such test' WHEN p_partkey % 4 = 3 THEN 'test_covers_' || p_partkey ELSE 'covers ' || p_partkey END AS name,
  CASE WHEN p_partkey % 11 > 0 THEN CASE WHEN p_partkey % 4 = 3 THEN 't/test_p' || p_partkey || '.py' ELSE 't/p' || p_partkey || '.test.ts' END END AS path FROM part)"""

SQL = {
    "oracle_domains": f"""WITH {_NAMED}, a(py, i, verdict, reason, expr, floor) AS (VALUES (false, 0, 'live', 'imported', 'REG', false), (false, 1, 'live', 'imported', 'REG', true), (false, 2, 'literal', 'const-array', 'LIST', NULL),
          (false, 3, 'literal', 'inline-literal', '[''a'', ''b'']', NULL), (false, 4, 'no-iteration', NULL, NULL, NULL), (false, 5, 'live', 'imported', 'REG', false), (false, 6, 'live', 'call-root', 'rows()', false),
          (true, 0, 'live', 'call-root', 'sorted(REG)', true), (true, 1, 'literal', 'inline-literal', '[''a'', ''b'']', NULL), (true, 2, 'no-iteration', NULL, NULL, NULL))
        SELECT k, name, path, coalesce(verdict, 'not-found') AS verdict, reason, expr, floor FROM n LEFT JOIN a ON NOT none AND a.py = n.py AND i = CASE WHEN n.py THEN p ELSE s END""",
    "parity_oracles": f"""WITH {_NAMED} SELECT k, name, path, CASE WHEN none THEN 'not-found' WHEN py THEN CASE WHEN p = 0 THEN 'ok' ELSE 'no-enumeration' END WHEN s IN (0, 1, 5) THEN 'ok' ELSE 'no-enumeration' END AS verdict FROM n""",
    "prior_owners": """SELECT 'c' || c_custkey || '.test.ts' AS path, 'c does <' || c_custkey || '>' AS full_name, list_extract(['complete', 'incomplete', 'deleted'], CAST(c_custkey % 5 AS INTEGER)) AS current FROM customer WHERE c_custkey % 5 BETWEEN 1 AND 3""",
    "static_resolution": """SELECT 'does <' || c_custkey || '>' AS name, CASE WHEN c_custkey % 5 IN (0, 4) THEN 'found' WHEN c_custkey % 5 = 2 THEN 'unknown' ELSE 'absent' END AS state FROM customer
        UNION ALL SELECT 'never <' || c_custkey || '>', 'unknown' FROM customer""",
    "facts_at_refs": """SELECT 'head' AS ref, f AS fact, count(*) AS n, count(*) AS names FROM customer, (VALUES ('symbol'), ('test')) AS x(f) GROUP BY f
        UNION ALL SELECT 'now', f, count(*), count(*) FROM customer, (VALUES ('symbol'), ('test')) AS x(f) WHERE c_custkey % 5 <> 3 AND (f = 'symbol' OR c_custkey % 5 <> 2) GROUP BY f""",
    "regulation_readings": """WITH r AS (SELECT o_orderkey AS k, o_orderkey % 17 = 0 OR o_orderkey % 19 = 0 AS blind FROM orders)
        SELECT k, 'canonical-lifecycle-control' AS rule, CASE WHEN k % 7 = 0 OR k % 11 = 0 THEN 'unavailable' WHEN k % 13 = 0 THEN 'violated' ELSE 'satisfied' END AS status FROM r
        UNION ALL SELECT k, 'significant-growth-needs-address', CASE k % 4 WHEN 3 THEN 'unavailable' WHEN 2 THEN 'violated' ELSE 'satisfied' END FROM r
        UNION ALL SELECT k, 'swarm-coordination-integrity', CASE WHEN blind THEN 'unavailable' WHEN 0 IN (k % 23, k % 29, k % 31, k % 37, k % 41, k % 43) THEN 'violated' ELSE 'satisfied' END FROM r
        UNION ALL SELECT k, 'completed-work-needs-explicit-verification', CASE WHEN blind THEN 'unavailable' WHEN k % 5 = 0 THEN 'violated' ELSE 'satisfied' END FROM r""",
    "defects_trusted": """WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 33 = 1 THEN 'corrupt' WHEN c_custkey % 14 = 3 THEN 'summary' WHEN c_custkey % 21 = 5 THEN 'forged' END AS code FROM customer)
        SELECT 'sound:rows' AS what, count(*) AS n FROM c UNION ALL SELECT 'damaged:rows', CASE WHEN count(code) = 0 THEN count(*) ELSE 0 END FROM c UNION ALL SELECT 'damaged:' || code, count(*) FROM c WHERE code IS NOT NULL GROUP BY code""",
    "external_claims": """WITH c AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 404 ELSE 200 END AS wanted, CASE WHEN o_orderkey % 14 = 0 THEN 404 ELSE 200 END AS got, o_orderkey % 3 = 0 AS said FROM orders)
        SELECT 'http://h/' || k || ' responds ' || wanted || CASE WHEN said THEN ' with "ok ' || (k % 10) || '"' ELSE '' END AS claim,
          CASE WHEN k % 5 = 0 THEN 'skip' WHEN wanted = got AND (NOT said OR contains('<b>ok ' || (k % 20) || '</b>', 'ok ' || (k % 10))) THEN 'pass' ELSE 'fail' END AS kind FROM c
        UNION ALL SELECT 'typechecks', CASE WHEN bool_and(o_orderkey % 9 <> 0) THEN 'pass' ELSE 'fail' END FROM orders""",
}
