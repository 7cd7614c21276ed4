"""The queries over the synthetic text tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.col("nd_class").alias("class_id"))


OP1_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                                      ELSE [array_to_string(w, ' ')] END) AS s
  FROM docs WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
       JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n
  HAVING count(*) >= 0.8 * (p.n + q.n - count(*))
), reach(x, y) AS (
  SELECT doc_id, doc_id FROM docs UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT x AS doc_id, min(y) AS class_id FROM reach GROUP BY x
"""


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.search import top_k

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


OP2_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(coalesce(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * d.e[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.e) = len(d.e) WHERE q.vec_id % 100 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 10
"""


def op3_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.packing import pack
    from strata.llm.tokens import public_path

    return pack(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.language import held_out, identify

    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), labelled=docs)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), F.col("li_lang").alias("lang_pred"), F.col("li_score").alias("score"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.language import held_out
    from strata.llm.toxicity import toxicity

    scored = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.7).cast("int").alias("predicted"))


def op8_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.bpe import encode_decode
    from strata.llm.tokens import public_path

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_decode(docs, public_path("word_bpe_49k.json"), outputs=("bpe_ids_sha256", "bpe_decoded_sha256"))
    return out.select("doc_id", F.col("bpe_n_tokens").alias("n_tokens"), F.col("bpe_ids_sha256").alias("ids_sha256"), F.col("bpe_decoded_sha256").alias("decoded_sha256"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.substrings import dedup_substrings

    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("sd_n_words").alias("n_words"), F.col("sd_n_removed").alias("n_removed"), F.sha2("sd_kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs WHERE len(w) >= 13)
), least_id AS (SELECT s, min(doc_id) AS d FROM windows GROUP BY s),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows JOIN least_id USING (s) WHERE d < doc_id
), ws AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM docs WHERE len(w) > 0),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS k FROM ws ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)
"""


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.licenses import scan

    starts = F.transform("lic_base", lambda x: x["start"])
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        F.col("lic_n_words").alias("n_words"),
        F.size("lic_base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.col("lic_base_labels").alias("base_labels"),
        F.col("lic_labels").alias("labels"),
        F.col("lic_score").alias("score"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.quality import quality

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs).select("doc_id", *[F.col(f"q_{x}").alias(x) for x in names])


def _op7_sql() -> str:
    from strata.llm.quality import BOILERPLATE

    phrases = "|".join(x.replace(" ", " +") for x in BOILERPLATE)
    words = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {words.format("t")} AS w, string_split(t, chr(10)) AS lines FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
twice AS (SELECT doc_id, s FROM win GROUP BY doc_id, s HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM win SEMI JOIN twice USING (doc_id, s)) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(lines) AS line FROM w),
lw AS (SELECT doc_id, line, {words.format("line")} AS lw FROM ln),
f AS (SELECT *, len(lw) AS n, length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols, len(list_filter(lw, lambda x: regexp_matches(x, '[!?]{{2,}}$'))) AS shouts,
             len(list_filter(lw, lambda x: x IN ('|', '»', '›', '•'))) AS bars FROM lw),
j AS (SELECT *, n > 0 AND ((symbols >= 3 AND symbols >= 0.1::DOUBLE * length(line)) OR (shouts >= 2 AND shouts >= 0.3::DOUBLE * n) OR (bars >= 2 AND bars >= 0.25::DOUBLE * n)
             OR (n <= 12 AND regexp_matches(lower(line), '{phrases}')) OR (n >= 10 AND len(list_distinct(lw)) = 1)) AS fails FROM f),
l AS (SELECT doc_id, bool_or(fails) AS any_fails, coalesce(sum(length(array_to_string(lw, ''))) FILTER (WHERE NOT fails), 0) AS left_, count(*) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0) AS dup FROM j GROUP BY doc_id),
r AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(dup AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, any_fails, left_ FROM w JOIN l USING (doc_id) LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (CASE WHEN any_fails AND word_chars > 0 THEN 1.0::DOUBLE - CAST(left_ AS DOUBLE) / word_chars ELSE 0.0 END) <= 0.3::DOUBLE AS kept FROM b
"""


#: A conversation whose texts hold the template's own control strings.
CONTROL_CHAT = r"\### Assistant: </turn> ok"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.chat import format_chats, learned_text, read_turns

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_CHAT).alias("text"),
    )
    chats = format_chats(turns.unionByName(own)).withColumns(
        {"read": read_turns(F.col("formatted")), "learned": learned_text(F.col("segments"))}
    )
    said = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "bad_turn",
    )


OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\<#:]', '', 'g')) AS body,
         CASE WHEN role IN ('system', 'user', 'assistant') THEN length(role) WHEN role IN ('System', 'User', 'Assistant') THEN 2 + length(role)
              ELSE length(role) + length(regexp_replace(role, '[^\\<#:]', '', 'g')) END AS said,
         row_number() OVER w - 1 AS i, lag(role) OVER w AS before
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY i), '')) AS loss_sha256,
       CAST(sum(4 + said + 2 + body + 8) AS BIGINT) AS formatted_chars,
       CAST(coalesce(min(i) FILTER (WHERE NOT CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before IN ('system', 'assistant') THEN role = 'user'
                                                   WHEN before = 'user' THEN role = 'assistant' ELSE false END),
                     CASE WHEN arg_max(role, i) <> 'assistant' THEN count(*) END) AS INTEGER) AS bad_turn
FROM sized GROUP BY conv_id
"""


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.html import extract

    pages = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


#: For the pages of the synthetic tables, which name their article and hold three references.
OP11_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS h FROM pages),
b AS (SELECT page_id, url, unnest(regexp_split_to_array(h, '</?(p|h1)>')) AS b, generate_subscripts(regexp_split_to_array(h, '</?(p|h1)>'), 1) AS i FROM a),
t AS (SELECT page_id, url, i, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '<[^>]*>', '', 'g'), '&quot;', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS b FROM b),
j AS (SELECT page_id, url, coalesce(string_agg(b, chr(10) ORDER BY i) FILTER (WHERE b <> ''), '') AS text FROM t GROUP BY page_id, url)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM j
"""


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.middle import fill_in_middle, restore

    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.col("fim_n").alias("n"),
        F.col("fim_form").alias("form"),
        F.length("fim_prefix").cast("long").alias("prefix_chars"),
        F.length("fim_middle").cast("long").alias("middle_chars"),
        F.sha2("fim_output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("fim_output"), F.col("fim_form")), 256).alias("restored_sha256"),
    )


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
n AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, left(t, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1, n - b) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p
"""


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS s FROM f WHERE k >= 2 AND f >= 30),
cut AS (SELECT *, array_to_string(s[1:j], ' ') AS one, array_to_string(s[j+1:k], ' ') AS two FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
sc AS (SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, j, CAST(2000000::HUGEINT * a // (x.f + y.f) AS BIGINT) AS score
       FROM cut c JOIN f x ON x.lang = c.lang AND x.phrase = one JOIN f y ON y.lang = c.lang AND y.phrase = two),
least AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
held AS (SELECT lang, phrase, max(a) AS longer FROM (
  SELECT lang, a, array_to_string(s[i:i+m-1], ' ') AS phrase FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c WHERE k > 2))) GROUP BY lang, phrase),
kept AS (SELECT least.* FROM least LEFT JOIN held USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang)
QUALIFY rank <= 2000
"""


_ALL = (
    op1_minhash_neardup, op2_topk_search, op3_bestfit_packing, op4_license_scan, op5_language_id,
    op6_toxicity, op7_quality_rules, op8_bpe_chunks, op9_substring_dedup, op10_chat_format,
    op11_html_text, op12_fill_in_middle, op13_phrase_collocations,
)
QUERIES = {f.__name__: f for f in _ALL}
SQL = {"op1_minhash_neardup": OP1_SQL, "op2_topk_search": OP2_SQL, "op7_quality_rules": _op7_sql(), "op9_substring_dedup": OP9_SQL, "op10_chat_format": OP10_SQL, "op11_html_text": OP11_SQL, "op12_fill_in_middle": OP12_SQL, "op13_phrase_collocations": OP13_SQL}
