"""Ratchets and diffs: excursions, rename absorption, snapshot differences, surface and novelty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.columns import family_of


def excursions(dims: DataFrame, base: DataFrame, tolerance: DataFrame | None = None) -> DataFrame:
    """(key, value, baseline, tolerance): dims(key, value) that are new or above baseline + tolerance.
    Shrinking is never one."""
    rows = dims.join(base.select("key", F.col("value").alias("baseline")), "key", "left")
    rows = rows.join(tolerance.select("key", "tolerance"), "key", "left") if tolerance is not None else rows.withColumn("tolerance", F.lit(0.0))
    rows = rows.withColumn("tolerance", F.coalesce("tolerance", F.lit(0.0)))
    return rows.where(F.col("baseline").isNull() | (F.col("value") > F.col("baseline") + F.col("tolerance"))).select("key", "value", "baseline", "tolerance")


def renames(current: DataFrame, base: DataFrame, *address: str, key: str = "key") -> DataFrame:
    """(from, to): vanished and new keys with the same address, paired in key order; as many as the
    shorter side has. address: columns that a move leaves alone (null equals null)."""
    by = Window.partitionBy(*address).orderBy(key)
    side = lambda a, b, name: a.join(b.select(key), key, "left_anti").withColumn("_r", F.row_number().over(by)).select(F.col(key).alias(name), "_r", *[F.col(c).alias(f"{name}_{c}") for c in address])
    gone, new = side(base, current, "from"), side(current, base, "to")
    on = gone["_r"] == new["_r"]
    for c in address:
        on = on & gone[f"from_{c}"].eqNullSafe(new[f"to_{c}"])
    return gone.join(new, on).select("from", "to")


def reconcile(current: DataFrame, base: DataFrame) -> DataFrame:
    """(from, to, value) of dims(key, value, unit) that were renamed: same family, unit and value."""
    rows = lambda d: d.select("key", "value", "unit", family_of(F.col("key")).alias("family"))
    found = renames(rows(current), rows(base), "family", "unit", "value")
    return found.join(current.select(F.col("key").alias("to"), "value"), "to").select("from", "to", "value")


def effective_base(current: DataFrame, base: DataFrame) -> DataFrame:
    """base with renamed keys under their new names."""
    moved = reconcile(current, base).select(F.col("from").alias("key"), "to")
    return base.join(moved, "key", "left").select(F.coalesce("to", "key").alias("key"), "value", "unit")


def diff(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys…, change): added, removed or changed rows between two snapshots with unique keys."""
    pack = lambda d, n: d.select(*keys, F.struct(*values).alias(n))
    both = pack(before, "b").join(pack(after, "a"), keys, "full_outer")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select(*keys, change.alias("change")).where("change is not null")


def surface_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row from surface(kind, name, member): new_exports, removed_exports, new_variants. An export
    has kind 'export'; a variant is a member of a domain that the domain did not have."""
    both = before.withColumn("old", F.lit(True)).unionByName(after.withColumn("old", F.lit(False)))
    ways = both.groupBy("kind", "name", "member").agg(F.bool_or("old").alias("before"), F.bool_or(~F.col("old")).alias("after"))
    is_ = lambda k, w: F.count_if((F.col("kind") == k) & ~F.col(w))
    return ways.agg(is_("export", "before").alias("new_exports"), is_("export", "after").alias("removed_exports"), is_("domain", "before").alias("new_variants"))


def novelty(signals: DataFrame, *, min_surface: int = 8, min_loc: int = 400, ratio: int = 12) -> DataFrame:
    """signals(new_exports, new_variants, loc_added, loc_deleted, anchors_added) plus surface, level and
    proviso (the signal may be churn)."""
    surface, anchors = F.col("new_exports") + F.col("new_variants"), F.col("anchors_added")
    level = (
        F.when((anchors == 0) & ((surface >= min_surface) | (F.col("loc_added") >= min_loc)), "alarm")
        .when((anchors > 0) & (surface >= min_surface) & (surface > anchors * ratio), "outpacing")
        .otherwise("quiet")
    )
    churn = (surface < min_surface) | (F.col("loc_deleted") * 2 >= F.col("loc_added"))
    return signals.withColumns({"surface": surface, "level": level}).withColumn("proviso", (F.col("level") != "quiet") & churn)


def signal_state(rows: DataFrame) -> DataFrame:
    """rows(level, anchors_added, attested) plus state."""
    state = F.when(F.col("level") == "quiet", "quiet").when((F.col("level") != "alarm") | (F.col("anchors_added") > 0), "anchored").when(F.col("attested"), "attested").otherwise("needs-decision")
    return rows.withColumn("state", state)


# The keys of totals, and the name of what no component owns.
TOTALS = ("lines|total", "files|total", "symbols|total", "undocumented|symbols")
UNOWNED = "(unowned)"


def documented(prose: Column) -> Column:
    return F.coalesce(F.trim(prose), F.lit("")) != ""


def structural_dims(nodes: DataFrame, stats: DataFrame) -> DataFrame:
    """(key, value, unit) from nodes(id, kind, component, path, prose) and stats(path, lines): lines in
    all and of each component, files, symbols, and symbols without prose."""
    files = nodes.where("kind = 'file'").join(stats, "path", "left").withColumn("n", F.coalesce("lines", F.lit(0)))
    per = files.groupBy(F.concat(F.lit("lines|"), F.coalesce("component", F.lit(UNOWNED))).alias("key")).agg(F.sum("n").cast("double").alias("value")).withColumn("unit", F.lit("lines"))
    symbol = F.col("kind") == "symbol"
    whole = nodes.agg(F.count_if(F.col("kind") == "file").alias("f"), F.count_if(symbol).alias("s"), F.count_if(symbol & ~documented(F.col("prose"))).alias("u"))
    one = lambda df, key, c, unit: df.select(F.lit(key).alias("key"), F.col(c).cast("double").alias("value"), F.lit(unit).alias("unit"))
    lines = one(files.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")), TOTALS[0], "n", "lines")
    return reduce(DataFrame.unionByName, (per, lines, one(whole, TOTALS[1], "f", "files"), one(whole, TOTALS[2], "s", "symbols"), one(whole, TOTALS[3], "u", "symbols")))


def population(dims: DataFrame) -> DataFrame:
    """One row: the files and symbols that dims(key, value) were read over."""
    return dims.agg(F.coalesce(F.sum(F.when(F.col("key").isin(*TOTALS[1:3]), F.col("value"))), F.lit(0.0)).alias("population"))
