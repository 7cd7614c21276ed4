"""Change-history queries over orders and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import history as H
from strata.plans import roles as R

_CF = """
cf AS (SELECT DISTINCT l_orderkey AS hash, 'p:' || l_partkey AS path FROM lineitem),
banded AS (SELECT hash FROM cf GROUP BY hash HAVING count(*) BETWEEN 2 AND 40),
f AS (SELECT 'p:' || p_partkey AS path, p_brand AS component, CAST(p_size AS BIGINT) AS lines FROM part
      UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, CAST(s_nationkey AS BIGINT) FROM supplier),
known AS (SELECT hash, path, component FROM cf SEMI JOIN banded USING (hash) JOIN f USING (path)),
few AS (SELECT hash, path, component FROM cf JOIN f USING (path) SEMI JOIN (SELECT hash FROM cf GROUP BY hash HAVING count(*) <= 40) USING (hash)),
deltas AS (SELECT l_orderkey AS hash, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS added,
                  sum(CASE WHEN l_returnflag <> 'N' THEN l_quantity ELSE 0 END) AS deleted FROM lineitem GROUP BY 1),
edges AS (SELECT DISTINCT 's:' || l_suppkey AS source, 'p:' || l_partkey AS target FROM lineitem),
adj AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges),
members AS (SELECT hash, path FROM cf SEMI JOIN f USING (path)
            UNION SELECT cf.hash, adj.b FROM cf JOIN f USING (path) JOIN adj ON adj.a = cf.path SEMI JOIN f g ON g.path = adj.b),
closed AS (SELECT hash, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines FROM members JOIN f USING (path) GROUP BY hash),
dated AS (SELECT o_orderkey AS hash, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS age FROM orders),
shaped AS (SELECT hash, count(DISTINCT component) AS comps, count(*) AS n FROM few GROUP BY hash),
rich AS (SELECT hash, age, comps, n, coalesce(deleted > added, false) AS prune FROM shaped JOIN dated USING (hash) LEFT JOIN deltas USING (hash)),
dev AS (SELECT hash, age, comps, row_number() OVER (ORDER BY age) AS place, count(*) OVER () AS total FROM rich WHERE NOT prune)
"""


def coupling_locality(spark, d):
    return H.coupling(R.commit_files(spark, d), R.files(spark, d))


def top_seams(spark, d):
    return H.seams(R.commit_files(spark, d), R.files(spark, d))


def god_files(spark, d):
    return H.spanning_files(R.commit_files(spark, d), R.files(spark, d), least=3)


def component_hubs(spark, d):
    return H.importers(R.imports(spark, d), R.files(spark, d), least=4)


def file_churn(spark, d):
    return H.file_churn(R.commit_files(spark, d))


def component_churn(spark, d):
    return H.component_churn(R.commit_files(spark, d), R.files(spark, d))


def net_delta_series(spark, d):
    return H.net_series(R.commits(spark, d), R.deltas(spark, d))


def _rich(spark, d):
    return H.enriched(R.commits(spark, d), R.commit_files(spark, d), R.files(spark, d), R.deltas(spark, d))


def drift_windows(spark, d):
    return H.drift_windows(_rich(spark, d))


def drift_seams(spark, d):
    return H.drift_seams(_rich(spark, d))


def recent_gestures(spark, d):
    return H.gestures(_rich(spark, d)).select("hash", "kind")


def _sets(spark, d):
    return H.closure_sets(R.commit_files(spark, d), R.files(spark, d), R.imports(spark, d))


def closure_stats(spark, d):
    return H.closure_stats(H.closure_sizes(_sets(spark, d)[0]))


def closure_attribution(spark, d):
    return H.closure_counts(*_sets(spark, d)[:2])


def closure_series(spark, d):
    return H.closure_series(H.closure_sizes(_sets(spark, d)[0]), R.commits(spark, d))


def mean_closure_by_component(spark, d):
    sets, _, named = _sets(spark, d)
    return H.mean_closure_of_sets(sets, named)


def read_hubs(spark, d):
    sets, numbered, _ = _sets(spark, d)
    considered = R.commit_files(spark, d).join(numbered, "path", "left_semi").agg(F.count_distinct("hash").alias("considered"))
    return H.hubs(H.closure_counts(sets, numbered), considered, share=0.01)


def crossing_heat(spark, d):
    symbols = R.table(spark, d, "part").select(F.col("p_type").alias("symbol"), R.part_path().alias("path"))
    return H.crossing_heat(symbols, R.commit_files(spark, d))


def hot_doc_gaps(spark, d):
    gaps = R.table(spark, d, "part").where("p_size < 5").select(R.part_path().alias("path"), "p_name")
    return H.doc_gaps(gaps, R.commit_files(spark, d)).where("heat >= 0.0005")


def calibration_stats(spark, d):
    rows = R.table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.collect_set("l_suppkey").alias("observed"), F.collect_set("l_partkey").alias("changed"), F.collect_set((F.col("l_suppkey") + F.col("l_linenumber") % 2)).alias("predicted"), F.max("l_returnflag").alias("flag"),
    )
    outcome = F.when(F.col("flag") == "R", "defect").when(F.col("flag") == "N", "clean").otherwise("unknown")
    return H.calibration(rows.select((F.col("l_orderkey") % 4000).alias("id"), F.col("l_orderkey").alias("ord"), outcome.alias("outcome"), "predicted", "observed", "changed"))


QUERIES = {
    f.__name__: f
    for f in (
        coupling_locality, top_seams, god_files, component_hubs, file_churn, component_churn, net_delta_series, drift_windows, drift_seams, recent_gestures,
        closure_stats, closure_attribution, closure_series, mean_closure_by_component, read_hubs, crossing_heat, hot_doc_gaps, calibration_stats,
    )
}

_PAIRS = "SELECT a.hash, a.component AS ca, b.component AS cb FROM known a JOIN known b ON a.hash = b.hash AND a.path < b.path"

SQL = {
    "coupling_locality": f"""WITH {_CF}, p AS ({_PAIRS})
        SELECT (SELECT count(*) FROM banded) AS commits, count(*) FILTER (WHERE ca = cb) AS within, count(*) FILTER (WHERE ca <> cb) AS cross,
               CASE WHEN count(*) = 0 THEN 1.0 ELSE count(*) FILTER (WHERE ca = cb) / CAST(count(*) AS DOUBLE) END AS locality FROM p""",
    "top_seams": f"""WITH {_CF}, p AS ({_PAIRS})
        SELECT least(ca, cb) AS a, greatest(ca, cb) AS b, count(*) AS pairs FROM p WHERE ca <> cb GROUP BY 1, 2 ORDER BY pairs DESC, a, b LIMIT 8""",
    "god_files": f"""WITH {_CF}
        SELECT x.path, count(DISTINCT y.component) AS span FROM known x JOIN known y ON x.hash = y.hash AND x.component <> y.component GROUP BY x.path HAVING count(DISTINCT y.component) >= 3""",
    "component_hubs": f"""WITH {_CF}
        SELECT t.component, count(DISTINCT s.component) AS fan_in FROM edges JOIN f s ON s.path = source JOIN f t ON t.path = target
        WHERE s.component <> t.component GROUP BY t.component HAVING count(DISTINCT s.component) >= 4""",
    "file_churn": f"WITH {_CF} SELECT path, count(*) AS touches FROM cf SEMI JOIN banded USING (hash) GROUP BY path",
    "component_churn": f"WITH {_CF} SELECT component, count(DISTINCT hash) AS commits FROM few GROUP BY component",
    "net_delta_series": f"""WITH {_CF}, b AS (SELECT hash, CAST(floor((age - 1) / ceil((SELECT count(*) FROM orders) / 8.0)) AS INTEGER) AS bucket FROM dated)
        SELECT bucket, sum(coalesce(added - deleted, 0)) AS net FROM b LEFT JOIN deltas USING (hash) GROUP BY bucket""",
    "drift_windows": f"""WITH {_CF}, b AS (SELECT hash, comps, CAST(floor((place - 1) / ceil(total / 8.0)) AS INTEGER) AS bucket FROM dev),
        p AS (SELECT a.hash, count(*) AS pairs, count(*) FILTER (WHERE a.component = c.component) AS within FROM few a JOIN few c ON a.hash = c.hash AND a.path < c.path GROUP BY a.hash)
        SELECT bucket, CASE WHEN coalesce(sum(pairs), 0) = 0 THEN 1.0 ELSE CAST(sum(within) AS DOUBLE) / CAST(sum(pairs) AS DOUBLE) END AS locality, avg(comps) AS spread FROM b LEFT JOIN p USING (hash) GROUP BY bucket""",
    "drift_seams": f"""WITH {_CF}, r AS (SELECT DISTINCT hash, component FROM few SEMI JOIN (SELECT hash FROM dev WHERE place > floor(total * 2 / 3.0)) USING (hash))
        SELECT a.component AS a, b.component AS b, count(*) AS commits FROM r a JOIN r b ON a.hash = b.hash AND a.component < b.component GROUP BY 1, 2 ORDER BY commits DESC, 1, 2 LIMIT 3""",
    "recent_gestures": f"""WITH {_CF}
        SELECT hash, CASE WHEN prune THEN 'prune' WHEN comps = 1 THEN 'converge' WHEN comps = 2 THEN 'couple' ELSE 'smear' END AS kind FROM rich ORDER BY age DESC LIMIT 12""",
    "closure_stats": f"""WITH {_CF}
        SELECT count(*) AS closures, coalesce(median(files), 0.0) AS median_files, CAST(coalesce(quantile_disc(files, 0.9), 0) AS DOUBLE) AS p90_files,
               coalesce(median(lines), 0.0) AS median_lines, CAST(coalesce(quantile_disc(lines, 0.9), 0) AS DOUBLE) AS p90_lines FROM closed""",
    "closure_attribution": f"WITH {_CF} SELECT path, count(*) AS closures FROM members GROUP BY path",
    "closure_series": f"""WITH {_CF}, o AS (SELECT files, row_number() OVER (ORDER BY age) AS place, count(*) OVER () AS total FROM closed JOIN dated USING (hash))
        SELECT CAST(floor((place - 1) / ceil(total / 8.0)) AS INTEGER) AS bucket, median(files) AS median_files FROM o GROUP BY 1""",
    "mean_closure_by_component": f"""WITH {_CF}, t AS (SELECT DISTINCT hash, component FROM members JOIN f USING (path))
        SELECT component, count(*) AS touches, avg(files) AS mean_files FROM t JOIN closed USING (hash) GROUP BY component ORDER BY mean_files DESC, component LIMIT 5""",
    "read_hubs": f"""WITH {_CF}, n AS (SELECT count(DISTINCT hash) AS considered FROM members)
        SELECT path, count(*) AS closures, any_value(considered) AS considered FROM members, n GROUP BY path HAVING any_value(considered) >= 12 AND count(*) >= 0.01 * any_value(considered)""",
    "crossing_heat": f"""WITH {_CF}, c AS (SELECT path, count(*) AS n FROM cf SEMI JOIN banded USING (hash) GROUP BY path)
        SELECT p_type AS symbol, max(coalesce(n / CAST((SELECT count(*) FROM banded) AS DOUBLE), 0.0)) AS heat FROM part LEFT JOIN c ON c.path = 'p:' || p_partkey GROUP BY p_type""",
    "hot_doc_gaps": f"""WITH {_CF}, c AS (SELECT path, count(*) AS n FROM cf SEMI JOIN banded USING (hash) GROUP BY path)
        SELECT 'p:' || p_partkey AS path, p_name, coalesce(n / CAST((SELECT count(*) FROM banded) AS DOUBLE), 0.0) AS heat
        FROM part LEFT JOIN c ON c.path = 'p:' || p_partkey WHERE p_size < 5 AND coalesce(n / CAST((SELECT count(*) FROM banded) AS DOUBLE), 0.0) >= 0.0005""",
    "calibration_stats": """WITH s AS (
          SELECT l_orderkey % 4000 AS id, l_orderkey AS ord, list_distinct(list(l_suppkey)) AS observed, list_distinct(list(l_suppkey + l_linenumber % 2)) AS predicted,
                 CASE max(l_returnflag) WHEN 'R' THEN 'defect' WHEN 'N' THEN 'clean' ELSE 'unknown' END AS outcome FROM lineitem GROUP BY l_orderkey),
        r AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY (outcome <> 'unknown') DESC, ord DESC) = 1),
        m AS (SELECT *, len(list_intersect(observed, predicted)) AS hit, len(observed) - len(list_intersect(observed, predicted)) AS outside FROM r)
        SELECT count(*) AS samples, avg(hit / CAST(len(observed) AS DOUBLE)) AS mean_coverage, avg(outside) AS mean_outside,
               avg(CASE WHEN outcome <> 'unknown' AND outside > 0 THEN CAST(outcome = 'defect' AS INTEGER) END) AS defect_rate_outside,
               avg(CASE WHEN outcome <> 'unknown' AND outside = 0 THEN CAST(outcome = 'defect' AS INTEGER) END) AS defect_rate_inside FROM m""",
}
