"""Queries over whole components, far nodes and exact ranks, made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import component_map, graph, quantiles
from strata.plans import roles as R


def _t(c):
    return c.cast("string")


def _parts(spark, d):
    k = F.col("p_partkey")
    return R.table(spark, d, "part").select(k.alias("k"), F.col("p_brand").alias("component"), F.col("p_size").alias("size"))


def _tables(spark, d):
    """Parts as files, claims, gates, invariants, refutations, symbols, crossings and reliances of their brands."""
    p, k = _parts(spark, d), F.col("k")
    inv = F.concat(F.lit("i"), _t(k % 13))
    files = p.select(_t(k).alias("path"), "component", F.col("size").alias("lines"), (k % 4 > 0).alias("accounted"))
    claims = p.where("k % 3 = 0").select("component", _t(k).alias("claim"), F.when(k % 2 == 0, inv).alias("inv"))
    grade = F.element_at(F.array(*[F.lit(g) for g in component_map.GRADES]), (k % 5 + 1).cast("int"))
    verdict = F.when(k % 7 == 0, "fail").when(k % 7 < 5, "pass").otherwise("unknown")
    gates = p.where("k % 2 = 1").select("component", inv.alias("inv"), grade.alias("grade"), verdict.alias("verdict"), (k % 6).alias("reliants"), k.alias("gate"))
    invariants = p.where("k % 5 = 2").select("component", inv.alias("inv"))
    refuted = p.where("k % 11 = 3").select("component", inv.alias("inv"))
    symbols = p.select(F.concat(F.lit("s"), _t(F.floor(k / 2))).alias("symbol"), "component", (k % 9 > 1).alias("documented"))
    crossings = p.where("k % 8 = 0").select(F.concat(F.lit("s"), _t(F.floor(k / 2))).alias("symbol"))
    relies = p.where("k % 4 = 1").select("component", F.when(k % 3 > 0, "g").alias("via"), F.concat(F.lit("z"), _t(k % 3)).alias("source"), F.concat(F.lit("z"), _t(k % 5)).alias("target"))
    return files, claims, gates, invariants, refuted, symbols, crossings, relies


def component_metrics(spark, d):
    """What there is to say of each brand as a component."""
    out = component_map.component_metrics(_parts(spark, d).select("component").distinct(), *_tables(spark, d))
    return out.withColumn("guards", F.concat_ws(" ", "guards"))


def gates_to_see(spark, d):
    """Gates that a look is due at, by how badly."""
    _, _, gates, _, refuted, *_ = _tables(spark, d)
    rows, total = component_map.gates_to_see(gates, refuted)
    seen = rows.select(_t(F.col("gate")).alias("gate"), "witnessed", F.concat_ws(" ", F.col("place.a").cast("int"), "place.b", "place.c").alias("place"))
    return seen.unionByName(total.select(F.lit("clean").alias("gate"), F.lit(None).cast("boolean").alias("witnessed"), F.concat_ws(" ", "clean", "total").alias("place")))


def far_reach(spark, d):
    """What the first customer (0) leads to along a chain of three quarters of them, each with a part as a leaf."""
    c = R.table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("source"))
    top = c.agg(F.floor(F.max("source") * 3 / 4).alias("top"))
    chain = c.crossJoin(F.broadcast(top)).where("source <> top").select("source", (F.col("source") + 1).alias("target"))
    leaves = c.select("source", (-F.col("source")).alias("target"))
    return graph.reach(chain.unionByName(leaves), spark.range(1).select(F.col("id").alias("node")))


SHARES = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]


def price_quantiles(spark, d):
    """Exact quantiles of the prices of all lines, and of their quantities, where thousands are equal."""
    li = R.table(spark, d, "lineitem")
    rows = [(c, *q) for c in ("l_extendedprice", "l_quantity") for q in quantiles.quantiles(li, c, SHARES)]
    return spark.createDataFrame(rows, "measure string, share double, between double, nearest double")


QUERIES = {f.__name__: f for f in (component_metrics, gates_to_see, far_reach, price_quantiles)}

_P = "p AS (SELECT p_partkey AS k, p_brand AS component, p_size AS size, 'i' || (p_partkey % 13) AS inv, CASE WHEN p_partkey % 7 = 0 THEN 'fail' WHEN p_partkey % 7 < 5 THEN 'pass' ELSE 'unknown' END AS verdict, ['U', 'D', 'C', 'B', 'A'][p_partkey % 5 + 1] AS grade FROM part)"

SQL = {
    "component_metrics": f"""WITH {_P}, i AS (SELECT DISTINCT component, inv FROM p WHERE k % 5 = 2), a AS (SELECT DISTINCT component, inv FROM p WHERE k % 3 = 0 AND k % 2 = 0), w AS (SELECT DISTINCT component, inv FROM p WHERE k % 11 = 3),
        iv AS (SELECT i.component, count(*) AS invariants, count(a.inv) AS anchored, count(w.inv) AS witnessed FROM i LEFT JOIN a USING (component, inv) LEFT JOIN w USING (component, inv) GROUP BY i.component),
        own AS (SELECT 's' || (k // 2) AS symbol, min(component) AS component FROM p GROUP BY 1 HAVING count(DISTINCT component) = 1),
        gd AS (SELECT component, string_agg(symbol, ' ' ORDER BY symbol) AS guards FROM own WHERE symbol IN (SELECT 's' || (k // 2) FROM p WHERE k % 8 = 0) GROUP BY component),
        b AS (SELECT component, count(*) AS files, CAST(sum(size) AS BIGINT) AS lines, count(*) FILTER (WHERE k % 4 > 0) AS accounted, count(*) FILTER (WHERE k % 3 = 0) AS claims, count(*) FILTER (WHERE k % 2 = 1) AS gates,
            count(*) FILTER (WHERE k % 2 = 1 AND grade = 'U') AS grade_u, count(*) FILTER (WHERE k % 2 = 1 AND grade = 'D') AS grade_d, count(*) FILTER (WHERE k % 2 = 1 AND grade = 'C') AS grade_c, count(*) FILTER (WHERE k % 2 = 1 AND grade = 'B') AS grade_b,
            count(*) FILTER (WHERE k % 2 = 1 AND grade = 'A') AS grade_a, count(*) FILTER (WHERE k % 2 = 1 AND verdict = 'fail') AS breaches, count(*) AS symbols, count(*) FILTER (WHERE k % 9 <= 1) AS undocumented,
            count(*) FILTER (WHERE k % 4 = 1 AND k % 3 = 0 AND k % 3 <> k % 5) AS naked FROM p GROUP BY component)
        SELECT b.*, coalesce(invariants, 0) AS invariants, coalesce(anchored, 0) AS anchored, coalesce(witnessed, 0) AS witnessed, coalesce(guards, '') AS guards FROM b LEFT JOIN iv USING (component) LEFT JOIN gd USING (component)""",
    "gates_to_see": f"""WITH {_P}, g AS (SELECT *, grade IN ('A', 'B') AND verdict <> 'fail' AS clean FROM p WHERE k % 2 = 1), w AS (SELECT DISTINCT component, inv FROM p WHERE k % 11 = 3)
        SELECT CAST(k AS VARCHAR) AS gate, w.inv IS NOT NULL AS witnessed, (CASE WHEN verdict = 'fail' THEN 0 ELSE 1 END) || ' ' || (k % 5 + 1) || ' ' || (-(k % 6)) AS place FROM g LEFT JOIN w USING (component, inv) WHERE NOT clean
        UNION ALL SELECT 'clean', NULL, count(*) FILTER (WHERE clean) || ' ' || count(*) FROM g""",
    "far_reach": "WITH t AS (SELECT max(c_custkey) * 3 // 4 AS top FROM customer) SELECT CAST(c_custkey AS BIGINT) AS node FROM customer, t WHERE c_custkey <= top UNION SELECT CAST(-c_custkey AS BIGINT) FROM customer, t WHERE c_custkey <= top",
    "price_quantiles": """WITH s AS (SELECT unnest([0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0])::DOUBLE AS share, unnest(range(1, 8)) AS i),
        v AS (SELECT 'l_extendedprice' AS measure, quantile_cont(l_extendedprice::DOUBLE, [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]) AS b, quantile_disc(l_extendedprice::DOUBLE, [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]) AS n FROM lineitem
              UNION ALL SELECT 'l_quantity', quantile_cont(l_quantity::DOUBLE, [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]), quantile_disc(l_quantity::DOUBLE, [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]) FROM lineitem)
        SELECT measure, share, b[i] AS "between", n[i] AS nearest FROM v, s""",
}
