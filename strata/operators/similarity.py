"""Exact set-similarity self-joins through an inverted index over rare tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.columns import once, round2, shingles
from strata.sources.shared import dealt, materialize


def rare_postings(sets: DataFrame, max_df: int) -> tuple[DataFrame, DataFrame]:
    """From sets(id, tokens): (id, token, df) of the tokens that 2 to max_df sets have, and the df of all tokens.

    A rare token's postings are at most max_df rows, so the self-join on it makes at most
    max_df / 2 pairs for each row, however frequent other tokens are.
    """
    exploded = sets.select("id", F.explode("tokens").alias("token"))
    df = exploded.groupBy("token").agg(F.count("*").alias("df"))
    return exploded.join(df.where(F.col("df").between(2, max_df)), "token"), df


def candidate_pairs(sets: DataFrame, max_df: int) -> DataFrame:
    """(a, b, shared, exclusive), a < b: sets with a rare token in common, how many they have, and
    how many of those no third set has."""
    posted, _ = rare_postings(sets, max_df)
    groups = posted.groupBy("token").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("df").alias("df"))
    pairs = F.flatten(F.transform("ids", lambda x, i: F.transform(F.slice(F.col("ids"), i + 2, F.greatest(F.size("ids") - i - 1, F.lit(0))), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    made = groups.select((F.col("df") == 2).alias("two"), F.explode(pairs).alias("p")).select("two", "p.a", "p.b")
    # Most pairs share one token, so summing them where they are made takes memory and leaves as many.
    n = sets.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    return dealt(made, n * max_df // 4, "a", "b").groupBy("a", "b").agg(F.count("*").alias("shared"), F.count_if("two").alias("exclusive"))


def _runs(k: int, max_df: int):
    """(uid, words) with words as hashes to (token, uid): the distinct runs of k words of each unit, as one hash. Of
    a run that more than max_df units of a batch have, max_df + 1 are enough to tell that it isn't rare."""
    import numpy as np
    import pyarrow as pa

    by = np.random.default_rng(6).integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def made(batches):
        for batch in batches:
            uid, words = batch.column(0).to_numpy(), batch.column(1)
            flat, n = words.flatten().to_numpy().view(np.uint64), words.value_lengths().to_numpy()
            if len(flat) < k:
                continue
            runs = len(flat) - k + 1
            h = sum(flat[j : j + runs] * by[j] for j in range(k))
            h ^= h >> np.uint64(32)
            whole = np.repeat(np.cumsum(n), n)[:runs] - np.arange(runs) >= k
            h, row = h[whole], np.repeat(np.arange(len(n)), n)[:runs][whole]
            order = np.lexsort((row, h))
            h, row = h[order], row[order]
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            h, row = h[first], row[first]
            start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
            rank = np.arange(len(h)) - np.repeat(start, np.diff(np.r_[start, len(h)]))
            few = rank <= max_df
            yield pa.RecordBatch.from_arrays([pa.array(h[few].view(np.int64)), pa.array(uid[row[few]])], ["token", "uid"])

    return made


def _met(max_df: int):
    """(token, uid) sorted by token to (a, b), a < b: units that have a token of 2 to max_df units in common. A token's
    rows that go on in the next batch are carried over, no more of them than tell that it isn't rare."""
    import numpy as np
    import pyarrow as pa

    def pairs(token, uid):
        start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]][: len(token)])
        n, out = np.diff(np.r_[start, len(token)]), []
        for size in range(2, max_df + 1):
            ids = np.sort(uid[start[n == size][:, None] + np.arange(size)], axis=1)
            i, j = np.triu_indices(size, 1)
            out.append(np.stack([ids[:, i].ravel(), ids[:, j].ravel()], axis=1))
        out = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        out = out[np.lexsort((out[:, 1], out[:, 0]))]
        out = out[np.r_[True, (out[1:] != out[:-1]).any(axis=1)][: len(out)]]
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])

    def made(batches):
        token = uid = np.zeros(0, np.int64)
        for batch in batches:
            token, uid = np.r_[token, batch.column(0).to_numpy()], np.r_[uid, batch.column(1).to_numpy()]
            if len(token):
                last = np.searchsorted(token, token[-1])
                yield pairs(token[:last], uid[:last])
                token, uid = token[last:][: max_df + 1], uid[last:][: max_df + 1]
        yield pairs(token, uid)

    return made


def prose_pairs(units: DataFrame, *, k: int = 6, min_words: int = 12, floor: float = 0.5, max_df: int = 6) -> DataFrame:
    """(a, b, shared, similarity, identical) of units(id, file, words), words without NUL: Jaccard over all shingles of
    pairs from different files that have a rare shingle in common.

    Candidates are found by 64-bit hashes of shingles and numbers of units; only units that are in a candidate
    pair meet with their words, and what is counted of them are their shingles themselves.
    """
    given = once(units.select("id", "file", F.col("words").alias("_given")), F.col("_given"), "words").drop("_given")
    # Read again for the pairs, and numbers of rows must not change between the two.
    live = materialize(given.where(F.size("words") >= min_words).withColumn("uid", F.monotonically_increasing_id()), "prose")
    posted = live.select("uid", F.transform("words", lambda w: F.xxhash64(w)).alias("words")).mapInArrow(_runs(k, max_df), "token long, uid long")
    pairs = posted.repartition("token").sortWithinPartitions("token").mapInArrow(_met(max_df), "a long, b long").distinct()
    # Files are compared before words move.
    place = live.select("uid", "id", "file")
    side = lambda c, rows: rows.select(*[F.col(x).alias(f"{c}_{x}") for x in rows.columns])
    named = pairs.join(side("x", place), F.col("a") == F.col("x_uid")).join(side("y", place), F.col("b") == F.col("y_uid")).where("x_file <> y_file")
    ahead = F.col("x_id") < F.col("y_id")
    named = named.select(*[F.when(ahead, F.col(f"{p}_{c}")).otherwise(F.col(f"{q}_{c}")).alias(n) for p, q, c, n in (("x", "y", "id", "a"), ("y", "x", "id", "b"), ("x", "y", "uid", "a_uid"), ("y", "x", "uid", "b_uid"))])
    # As one text the words take half the room; without the hint a small table of them, several times as large once it is
    # read, would go through the driver.
    words = live.select("uid", F.array_join("words", "\0").alias("words")).hint("merge")
    both = named.join(words.toDF("a_uid", "a_said"), "a_uid").join(words.toDF("b_uid", "b_said"), "b_uid")
    both = both.select("a", "b", F.split("a_said", "\0").alias("a_words"), F.split("b_said", "\0").alias("b_words"))
    both = once(once(both, shingles(F.col("a_words"), k), "a_tokens"), shingles(F.col("b_words"), k), "b_tokens")
    both = once(both, F.size(F.array_intersect("a_tokens", "b_tokens")), "shared")
    union = F.size("a_tokens") + F.size("b_tokens") - F.col("shared")
    return (
        both.withColumn("exact", F.coalesce(F.col("shared") / F.nullif(union, F.lit(0)), F.lit(0.0)))
        .where(F.col("exact") >= floor)
        .select("a", "b", "shared", round2(F.col("exact")).alias("similarity"), (F.col("a_words") == F.col("b_words")).alias("identical"))
    )


def untied_sites(sites: DataFrame, containment: float = 0.7) -> DataFrame:
    """sites(id, name, kind, file, keys, type_link) without those whose named type is a site that
    holds most of the smaller of the two key sets: the compiler already keeps them together."""
    linked = sites.where("type_link is not null and type_link <> name")
    anchors = sites.select(F.col("name").alias("type_link"), F.col("keys").alias("anchor"))
    overlap = F.size(F.array_intersect("keys", "anchor")) / F.least(F.size("keys"), F.size("anchor"))
    tied = linked.join(anchors, "type_link").where(overlap >= containment).select("id").distinct()
    return sites.join(tied, "id", "left_anti")


#: Kinds that are written in prose.
PROSE_KINDS = ("md-table", "alternation")


def domain_pairs(
    sites: DataFrame, declared: DataFrame | None = None, *,
    min_shared: int = 3, containment: float = 0.7, max_df: int = 6,
) -> DataFrame:
    """(a, b, shared, exclusive, only_a, only_b, score) of sites with most of their rare keys in common.

    Shared counts keys that at most max_df sites have; its share is of the smaller whole key set.
    A pair with the same type link, or with a side named in declared(name), is left out.
    """
    live = materialize(untied_sites(sites, containment), "sites")  # read five times below
    pairs = candidate_pairs(live.select("id", F.col("keys").alias("tokens")), max_df).where(F.col("shared") >= min_shared)
    side = lambda c: live.select(*[F.col(x).alias(f"{c}_{x}") for x in ("id", "name", "kind", "file", "keys", "type_link")])
    both = pairs.join(side("a"), F.col("a") == F.col("a_id")).join(side("b"), F.col("b") == F.col("b_id"))
    both = both.where(F.col("shared") / F.least(F.size("a_keys"), F.size("b_keys")) >= containment)
    both = both.where(~F.coalesce(F.col("a_type_link") == F.col("b_type_link"), F.lit(False)))
    if declared is not None:
        names = declared.select(F.col("name").alias("declared")).distinct()
        for c in ("a", "b"):
            both = both.join(names, F.col(f"{c}_name") == F.col("declared"), "left_anti")
    only_a, only_b = F.size(F.array_except("a_keys", "b_keys")), F.size(F.array_except("b_keys", "a_keys"))
    partial = lambda c: F.col(f"{c}_kind").isin("compare", "switch")
    expected = (partial("a") & (only_a == 0) & (only_b > 0)) | (partial("b") & (only_b == 0) & (only_a > 0))
    prose = lambda c: F.col(f"{c}_kind").isin(*PROSE_KINDS)
    is_ = lambda c, k: F.col(f"{c}_kind") == k
    kinds = F.when(is_("a", "shape") & is_("b", "shape"), 0.6).when((is_("a", "shape") & is_("b", "table")) | (is_("a", "table") & is_("b", "shape")), 1.3).otherwise(1.0)
    score = (
        F.col("shared") * (F.lit(0.35) + F.lit(0.65) * (F.col("exclusive") / F.col("shared")))
        * F.when(prose("a") != prose("b"), 1.25).otherwise(1.0) * kinds
        * F.when(F.col("a_file") == F.col("b_file"), 0.75).otherwise(1.0)
        * F.when(((only_a > 0) | (only_b > 0)) & ~expected, 1.4).otherwise(1.0)
    )
    return both.select("a", "b", "shared", "exclusive", only_a.alias("only_a"), only_b.alias("only_b"), round2(score).alias("score"))


def shown(pairs: DataFrame, top: int = 10, min_score: float = 3.5) -> DataFrame:
    return pairs.where(F.col("score") >= min_score).orderBy(F.desc("score"), F.desc("shared"), "a", "b").limit(top)
