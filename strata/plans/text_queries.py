"""Similarity and extraction queries over documents, pages and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.functions import columns as C
from strata.functions import markdown as M
from strata.operators import similarity as S
from strata.plans import roles as R

_UNITS = """
raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS said, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
units AS (SELECT doc_id || ':' || line AS id, doc_id AS file, list_filter(regexp_split_to_array(lower(said), '[^a-z0-9]+'), lambda w: w <> '') AS words FROM raw),
live AS (SELECT id, file, words, list_distinct(list_transform(range(1, len(words) - 4), lambda i: array_to_string(words[i:i+5], ' '))) AS toks FROM units WHERE len(words) >= 12),
ex AS (SELECT id, file, unnest(toks) AS t FROM live),
df AS (SELECT t, count(*) AS df FROM ex GROUP BY t),
cand AS (SELECT DISTINCT a.id AS a, b.id AS b FROM ex a JOIN ex b ON a.t = b.t AND a.id < b.id AND a.file <> b.file JOIN df ON df.t = a.t WHERE df.df <= 6),
scored AS (SELECT a, b, len(list_intersect(x.toks, y.toks)) AS shared, len(x.toks) AS nx, len(y.toks) AS ny, x.words = y.words AS identical FROM cand JOIN live x ON x.id = a JOIN live y ON y.id = b),
pairs AS (SELECT a, b, shared, floor(shared / CAST(nx + ny - shared AS DOUBLE) * 100 + 0.5) / 100 AS similarity, identical FROM scored WHERE shared / CAST(nx + ny - shared AS DOUBLE) >= 0.5)
"""

_SITES = """
sites AS (SELECT l_orderkey AS id, list_distinct(list(l_partkey)) AS keys, l_orderkey % 7 AS file,
                 list_extract(['union', 'shape', 'table', 'md-table', 'switch'], CAST(l_orderkey % 5 + 1 AS INTEGER)) AS kind FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_partkey) >= 3),
ex AS (SELECT id, unnest(keys) AS t FROM sites),
df AS (SELECT t, count(*) AS df FROM ex GROUP BY t),
cand AS (SELECT a.id AS a, b.id AS b, count(*) AS shared, count(*) FILTER (WHERE df = 2) AS exclusive FROM ex a JOIN ex b ON a.t = b.t AND a.id < b.id JOIN df ON df.t = a.t WHERE df <= {max_df} GROUP BY 1, 2),
met AS (SELECT c.*, x.keys AS xk, y.keys AS yk, x.kind AS xd, y.kind AS yd, x.file AS xf, y.file AS yf FROM cand c JOIN sites x ON x.id = a JOIN sites y ON y.id = b
        WHERE shared >= {min_shared} AND shared / CAST(least(len(x.keys), len(y.keys)) AS DOUBLE) >= {containment}),
two AS (SELECT *, CAST(len(xk) - len(list_intersect(xk, yk)) AS INTEGER) AS only_a, CAST(len(yk) - len(list_intersect(xk, yk)) AS INTEGER) AS only_b FROM met),
scored AS (SELECT a, b, shared, exclusive, only_a, only_b, floor(100 * (shared * (0.35::DOUBLE + 0.65::DOUBLE * (exclusive / CAST(shared AS DOUBLE)))
        * CASE WHEN (xd = 'md-table') <> (yd = 'md-table') THEN 1.25::DOUBLE ELSE 1 END
        * CASE WHEN xd = 'shape' AND yd = 'shape' THEN 0.6::DOUBLE WHEN (xd = 'shape' AND yd = 'table') OR (xd = 'table' AND yd = 'shape') THEN 1.3::DOUBLE ELSE 1 END
        * CASE WHEN xf = yf THEN 0.75::DOUBLE ELSE 1 END
        * CASE WHEN (only_a > 0 OR only_b > 0) AND NOT ((xd = 'switch' AND only_a = 0 AND only_b > 0) OR (yd = 'switch' AND only_b = 0 AND only_a > 0)) THEN 1.4::DOUBLE ELSE 1 END) + 0.5) / 100 AS score FROM two)
"""


def prose_pairs(spark, d):
    return S.prose_pairs(R.prose_units(spark, d))


def prose_diverged(spark, d):
    return S.prose_pairs(R.prose_units(spark, d)).where("not identical").orderBy(F.desc("similarity"), F.desc("shared"), "a", "b").limit(12)


#: Orders share few parts: looser than the defaults, which are for keys of code.
_LOOSE = {"min_shared": 2, "containment": 0.3, "max_df": 60}


def domain_pairs(spark, d):
    return S.domain_pairs(R.domain_sites(spark, d), **_LOOSE)


def domain_pairs_shown(spark, d):
    return S.shown(S.domain_pairs(R.domain_sites(spark, d), **_LOOSE), top=10, min_score=1.0)


def normalized_words(spark, d):
    w = C.normalize_words(F.col("text"))
    return R.table(spark, d, "benchmark").select("item_id", F.size(w).alias("n_words"), F.array_join(w, " ").alias("words"), F.size(C.shingles(w)).alias("n_shingles"))


def content_ids(spark, d):
    """Ids by content, safe labels, families and ages of orders."""
    o = R.table(spark, d, "orders")
    return o.select(
        "o_orderkey",
        C.content_id("d-", 8, F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_custkey")).alias("id"),
        C.slug(F.col("o_orderpriority")).alias("label"),
        C.family_of(F.concat_ws("|", "o_orderstatus", "o_orderpriority")).alias("family"),
        C.last_number(F.col("o_orderpriority")).alias("last"),
        C.human_age(F.col("o_orderkey") * 37).alias("age"),
    )


def markdown_prose(spark, d):
    """Lines of documents taken as markdown that are prose, without list marks."""
    return M.prose_lines(R.table(spark, d, "documents").select(F.col("doc_id").alias("file"), "text"))


def html_sinks(spark, d):
    """Attribute values of pages that come unquoted or from a script, by context."""
    found = F.explode(F.regexp_extract_all("html", F.lit(r"(href|src|class|id)=[\"']([^\"']*)[\"']"), F.lit(0)))
    rows = R.table(spark, d, "pages").select("page_id", found.alias("sink"))
    return rows.groupBy(F.substring_index("sink", "=", 1).alias("context")).agg(F.count("*").alias("sites"), F.count_distinct("page_id").alias("pages"), F.count_distinct("sink").alias("expressions"))


QUERIES = {f.__name__: f for f in (prose_pairs, prose_diverged, domain_pairs, domain_pairs_shown, normalized_words, content_ids, markdown_prose, html_sinks)}

SQL = {
    "prose_pairs": f"WITH {_UNITS} SELECT a, b, CAST(shared AS INTEGER) AS shared, similarity, identical FROM pairs",
    "prose_diverged": f"WITH {_UNITS} SELECT a, b, CAST(shared AS INTEGER) AS shared, similarity, identical FROM pairs WHERE NOT identical ORDER BY similarity DESC, shared DESC, a, b LIMIT 12",
    "domain_pairs": f"WITH {_SITES.format(**_LOOSE)} SELECT * FROM scored",
    "domain_pairs_shown": f"WITH {_SITES.format(**_LOOSE)} SELECT * FROM scored WHERE score >= 1.0 ORDER BY score DESC, shared DESC, a, b LIMIT 10",
    "normalized_words": """WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM benchmark)
        SELECT item_id, CAST(len(w) AS INTEGER) AS n_words, array_to_string(w, ' ') AS words,
               CAST(CASE WHEN len(w) >= 6 THEN len(list_distinct(list_transform(range(1, len(w) - 4), lambda i: array_to_string(w[i:i+5], ' ')))) ELSE 0 END AS INTEGER) AS n_shingles FROM w""",
    "content_ids": """SELECT o_orderkey, 'd-' || substr(sha256(o_orderstatus || chr(0) || o_orderpriority || chr(0) || o_custkey), 1, 8) AS id,
        CASE WHEN regexp_full_match(o_orderpriority, '[A-Za-z0-9_][A-Za-z0-9._-]*') AND NOT regexp_matches(o_orderpriority, '[-.]$') THEN o_orderpriority
             ELSE substr(regexp_replace(regexp_replace(o_orderpriority, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), 1, 40) || '-' || substr(sha256(o_orderpriority), 1, 8) END AS label,
        o_orderstatus AS family, CAST(nullif(regexp_extract(o_orderpriority, '(-?[0-9]+(\\.[0-9]+)?)', 1), '') AS DOUBLE) AS "last",
        CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' WHEN s < 86400 THEN (s // 3600) || 'h' ELSE (s // 86400) || 'd' END AS age
        FROM (SELECT *, o_orderkey * 37 AS s FROM orders)""",
    "markdown_prose": """WITH l AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS said, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
        f AS (SELECT *, sum(CASE WHEN regexp_matches(said, '^\\s*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line) AS fences FROM l)
        SELECT file, CAST(line AS INTEGER) AS line, regexp_replace(trim(said), '^([-*+]|[0-9]+\\.)\\s+', '') AS said FROM f
        WHERE fences % 2 = 0 AND NOT regexp_matches(said, '^\\s*(```|~~~)') AND NOT regexp_matches(said, '^\\s*(#|\\|)') AND trim(said) <> ''""",
    "html_sinks": """WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, '(href|src|class|id)=["'']([^"'']*)["'']')) AS sink FROM pages)
        SELECT split_part(sink, '=', 1) AS context, count(*) AS sites, count(DISTINCT page_id) AS pages, count(DISTINCT sink) AS expressions FROM s GROUP BY 1""",
}
