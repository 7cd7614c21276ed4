"""Queries over histories with versions and merges, and over many patterns at once, made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import ancestry, digests, globs, patterns, versions
from strata.plans import roles as R
from strata.sources.shared import materialize


def _t(c):
    return c.cast("string")


def _versions(spark, d):
    """Lines of orders as changes of a file for each part: content by quantity, returned ones delete."""
    li = R.table(spark, d, "lineitem").select(F.concat(F.lit("p"), _t(F.col("l_partkey"))).alias("path"), F.col("l_orderkey").alias("ord"), F.when(F.col("l_returnflag") != "R", F.concat(F.lit("q"), _t(F.col("l_quantity").cast("int") % 7))).alias("content"))
    return materialize(versions.versions(li), "versions")


def _refs(spark, d):
    """Fifty places spread over all orders."""
    o = R.table(spark, d, "orders").agg(F.max("o_orderkey").alias("n"))
    return spark.range(1, 51).crossJoin(o).select(F.col("id").alias("ref"), F.expr("n * id div 50").alias("ord"))


def snapshots_at_refs(spark, d):
    """What was there at fifty places of the history: files, and a sum over what they held."""
    at = versions.at_refs(_versions(spark, d), _refs(spark, d))
    return at.groupBy("ref").agg(F.count("*").alias("files"), F.sum(F.substring("content", 2, 9).cast("long")).alias("total"), F.min("path").alias("first"))


def differences_of_refs(spark, d):
    """What came, went and changed between each of fifty places and the next, and from the last back to the first."""
    refs = _refs(spark, d)
    pairs = refs.alias("x").join(refs.alias("y"), F.expr("y.ref = x.ref % 50 + 1")).select(F.col("x.ref").alias("pair"), F.col("x.ord").alias("a"), F.col("y.ord").alias("b"))
    diff = versions.differences(_versions(spark, d), pairs)
    return diff.groupBy("pair").agg(F.count_if(F.col("before").isNull()).alias("added"), F.count_if(F.col("after").isNull()).alias("removed"), F.count_if(F.col("before") != F.col("after")).alias("changed"))


def tree_changes(spark, d):
    """Orders as files under their customers at two times: what came, went and changed, by trees of digests."""
    k = F.col("o_orderkey")
    o = R.table(spark, d, "orders").select(k.alias("k"), F.concat_ws("/", F.concat(F.lit("r"), _t(F.col("o_custkey") % 10)), F.concat(F.lit("c"), _t(F.col("o_custkey"))), F.concat(F.lit("o"), _t(k))).alias("path"), _t(F.col("o_orderdate")).alias("content"))
    old = o.where("k % 101 <> 1")
    new = o.where("k % 103 <> 1").withColumn("content", F.when(F.col("k") % 97 == 1, "changed").otherwise(F.col("content")))
    return digests.changed(spark, *(digests.tree(x.select("path", "content"), 16) for x in (old, new)))


def _commits(spark, d):
    """Parts as commits of sixteen lanes, each fifth a merge of the lane beside it."""
    k = F.col("p_partkey").cast("long")
    return R.table(spark, d, "part").select(k.alias("hash"), F.when(k % 5 == 0, F.array(k - 16, k - 49)).otherwise(F.array(k - 16)).alias("parents"))


def merged_commits_since(spark, d):
    """How far the last part is from each fortieth, as commits of a history with merges; null off its line."""
    c = _commits(spark, d)
    refs = c.where("hash % 40 = 0").select("hash").unionByName(spark.range(-1, 0).select(F.col("id").alias("hash")))
    return ancestry.commits_since(c, refs, c.agg(F.max("hash").alias("hash")))


def merged_ancestors(spark, d):
    """Whether parts are ancestors of others, in a history with merges."""
    c = _commits(spark, d)
    places = materialize(ancestry.chains(c), "chains")
    refs = c.where("hash % 50 = 7").select("hash")
    labels = ancestry.reached(c, refs, places)
    pairs = c.select(F.col("hash").alias("other")).withColumn("hash", F.expr("other + 50 * (other % 9) + (57 - other % 50) % 50")).select("hash", "other")
    return ancestry.ancestors_of(pairs, labels, places)


def _globs():
    """Ten thousand globs by a rule: of each number a page of one language, a page with an address of its own, a page
    that is asked for with a parameter, and a host's pages."""
    langs = ("en", "de", "fr", "es")
    return [g for n in range(2500) for g in (f"*/{langs[n % 4]}/{n}#*", f"**/{n}.html", f"*.example.com/**/{n}?page=*", f"blog.**.net/*/{n}?*")]


def pages_by_glob(spark, d):
    """The first of ten thousand globs that each page's address fits."""
    pages = R.table(spark, d, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path"))
    return globs.first_match(pages, _globs())


def names_in_texts(spark, d):
    """Which texts of the benchmark, whole, and which single words, how many documents hold."""
    item = R.table(spark, d, "benchmark").select("text")
    names = item.select(F.col("text").alias("name")).unionByName(item.select(F.substring_index("text", " ", 1).alias("name")))
    met = patterns.containing(names, R.table(spark, d, "documents").select("text"))
    return met.groupBy("name").agg(F.count("*").alias("texts"))


QUERIES = {f.__name__: f for f in (tree_changes, pages_by_glob, names_in_texts, snapshots_at_refs, differences_of_refs, merged_commits_since, merged_ancestors)}

_CHANGES = """c AS (SELECT 'p' || l_partkey AS path, l_orderkey AS ord, max(CASE WHEN l_returnflag <> 'R' THEN 'q' || (CAST(l_quantity AS INTEGER) % 7) END) AS content FROM lineitem GROUP BY 1, 2),
    r AS (SELECT i AS ref, n * i // 50 AS ord FROM (SELECT max(o_orderkey) AS n FROM orders), range(1, 51) t(i)),
    s AS (SELECT ref, path, arg_max_null(content, c.ord) AS content FROM r JOIN c ON c.ord <= r.ord GROUP BY ref, path)"""
_CLOSURE = "p AS (SELECT p_partkey AS k, unnest(CASE WHEN p_partkey % 5 = 0 THEN [p_partkey - 16, p_partkey - 49] ELSE [p_partkey - 16] END) AS up FROM part), a(r, k) AS (SELECT p_partkey, p_partkey FROM part WHERE {} UNION SELECT a.r, p.up FROM a JOIN p ON p.k = a.k JOIN part ON p_partkey = p.up)"

SQL = {
    "tree_changes": """SELECT 'r' || (o_custkey % 10) || '/c' || o_custkey || '/o' || o_orderkey AS path, CASE WHEN o_orderkey % 101 = 1 THEN 'added' WHEN o_orderkey % 103 = 1 THEN 'removed' ELSE 'changed' END AS change
        FROM orders WHERE (o_orderkey % 101 = 1) <> (o_orderkey % 103 = 1) OR (o_orderkey % 97 = 1 AND o_orderkey % 101 <> 1 AND o_orderkey % 103 <> 1)""",
    "pages_by_glob": r"""WITH p AS (SELECT DISTINCT regexp_replace(url, '^https?://', '') AS path FROM pages), s AS (SELECT path, string_split(path, '/') AS s, len(string_split(path, '/')) AS k FROM p),
        g AS (SELECT n, ['en', 'de', 'fr', 'es'][n % 4 + 1] AS lang FROM range(2500) t(n)),
        m AS (SELECT path, 4 * n AS number FROM s, g WHERE k = 3 AND s[2] = lang AND starts_with(s[3], n || '#')
              UNION ALL SELECT path, 4 * n + 1 FROM s, g WHERE k >= 2 AND s[k] = n || '.html'
              UNION ALL SELECT path, 4 * n + 2 FROM s, g WHERE k >= 3 AND s[1] LIKE '%.example.com' AND starts_with(s[k], n || '?page=')
              UNION ALL SELECT path, 4 * n + 3 FROM s, g WHERE k >= 3 AND starts_with(s[1], 'blog.') AND array_to_string(s[1:k-2], '/') LIKE 'blog.%.net' AND starts_with(s[k], n || '?'))
        SELECT path, CAST(min(number) AS INTEGER) AS number FROM m GROUP BY path""",
    "names_in_texts": "WITH n AS (SELECT DISTINCT text AS name FROM benchmark UNION SELECT string_split(text, ' ')[1] FROM benchmark), d AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL) SELECT name, count(*) AS texts FROM n JOIN d ON contains(text, name) WHERE length(name) > 0 GROUP BY name",
    "snapshots_at_refs": f"WITH {_CHANGES} SELECT ref, count(*) AS files, CAST(sum(CAST(substr(content, 2) AS BIGINT)) AS BIGINT) AS total, min(path) AS \"first\" FROM s WHERE content IS NOT NULL GROUP BY ref",
    "differences_of_refs": f"""WITH {_CHANGES}, q AS (SELECT ref AS pair, ref % 50 + 1 AS other FROM r), x AS (SELECT pair, path, content FROM q JOIN s ON s.ref = pair WHERE content IS NOT NULL), y AS (SELECT pair, path, content FROM q JOIN s ON s.ref = other WHERE content IS NOT NULL),
        f AS (SELECT coalesce(x.pair, y.pair) AS pair, x.content AS b, y.content AS a FROM x FULL JOIN y ON x.pair = y.pair AND x.path = y.path WHERE x.content IS DISTINCT FROM y.content)
        SELECT pair, count(*) FILTER (WHERE b IS NULL) AS added, count(*) FILTER (WHERE a IS NULL) AS removed, count(*) FILTER (WHERE b <> a) AS changed FROM f GROUP BY pair""",
    "merged_commits_since": f"""WITH RECURSIVE {_CLOSURE.format("p_partkey % 40 = 0 OR p_partkey = (SELECT max(p_partkey) FROM part)")}, h AS (SELECT max(p_partkey) AS h FROM part), z AS (SELECT r, count(*) AS n FROM a GROUP BY r),
        refs AS (SELECT p_partkey AS hash FROM part WHERE p_partkey % 40 = 0 UNION ALL SELECT -1)
        SELECT hash, (SELECT n FROM z, h WHERE r = h) - z.n AS n FROM refs LEFT JOIN (SELECT z.* FROM z, h WHERE EXISTS (SELECT 1 FROM a WHERE a.r = h AND a.k = z.r)) z ON z.r = hash""",
    "merged_ancestors": f"""WITH RECURSIVE {_CLOSURE.format("p_partkey % 50 = 7")}, q AS (SELECT p_partkey AS other, p_partkey + 50 * (p_partkey % 9) + (57 - p_partkey % 50) % 50 AS hash FROM part)
        SELECT hash, other, CASE WHEN EXISTS (SELECT 1 FROM part WHERE p_partkey = hash) THEN EXISTS (SELECT 1 FROM a WHERE r = hash AND k = other) END AS "is" FROM q""",
}
