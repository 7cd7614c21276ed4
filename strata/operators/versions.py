"""History as versions: what every path held when, folded from a log of changes.

A version is a path's content from one place of the order up to the next change of that path. Snapshots
at any places and differences of any two come from these rows; none is stored for a ref. Both are
range joins made of equi-joins: a version is filed under the one or two blocks that it touches at the
level where blocks are as long as itself, a place asks one block at each level; a pair of places asks
for the blocks of equal width between them, a change lies in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Changes of one path are put in order within stretches of so many places, so that no path's whole history meets in one task.
STRETCH = 1 << 16
#: Blocks that the order is cut into for differences.
BLOCKS = 4096
VERSIONS = "path, content, before, start, end"


def versions(changes: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(path, content, before, start, end) of changes(path, ord, content): a version holds from start on and
    before end (null: still). A null content is a deletion, also a row here; before is the content that the
    version took the place of, null for none.

    Of several changes of one path at one place the greatest content counts, a deletion least. What doesn't
    change anything is no version: an equal content again, or a deletion of what isn't there. Rows with
    a null path or place play no part.
    """
    one = changes.where("path is not null and ord is not null").groupBy("path", F.col("ord").cast("long").alias("ord")).agg(F.max("content").alias("content"))
    moved = _neighbour(one, "content", "before", stretch, back=True)
    real = moved.where(~F.col("content").eqNullSafe(F.col("before")))
    return _neighbour(real, "ord", "end", stretch, back=False).select("path", "content", "before", F.col("ord").alias("start"), "end")


def _neighbour(rows: DataFrame, value: str, name: str, stretch: int, back: bool) -> DataFrame:
    """rows(path, ord, ...) plus the value of the path's row before (or after). Neighbours are found in stretches of the
    order; the ends of stretches, one row for each, find theirs in a second step."""
    cut = rows.withColumn("_s", F.floor(F.col("ord") / F.lit(stretch)))
    inner, outer = Window.partitionBy("path", "_s").orderBy("ord"), Window.partitionBy("path").orderBy("_s")
    pick = (lambda c, w: F.lag(c).over(w)) if back else (lambda c, w: F.lead(c).over(w))
    edge = (F.max_by if back else F.min_by)(F.struct(F.col(value).alias("v")), "ord")
    ends = cut.groupBy("path", "_s").agg(edge.alias("_edge")).withColumn("_far", pick("_edge", outer)).drop("_edge")
    near = cut.withColumn("_near", pick(F.struct(F.col(value).alias("v")), inner)).join(ends, ["path", "_s"])
    return near.withColumn(name, F.coalesce("_near", "_far")["v"]).drop("_s", "_near", "_far")


def _level(length: Column) -> Column:
    """The least level whose blocks, of 2^level places, are as long as that."""
    return F.length(F.bin(F.greatest(length - 1, F.lit(0)))).cast("int")


def at_refs(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref, path, content) of versions() rows at each of refs(ref, ord): what was there after the change at that place."""
    held = rows.where("content is not null")
    # An open version ends after all places that are asked for.
    last = refs.agg(F.max("ord").alias("_last"))
    span = held.crossJoin(F.broadcast(last)).where("start <= _last").withColumn("_to", F.least(F.coalesce("end", F.col("_last") + 1), F.col("_last") + 1))
    filed = span.withColumn("level", _level(F.col("_to") - F.col("start")))
    block = lambda at: F.expr(f"shiftright({at}, level)")
    filed = filed.withColumn("block", F.explode(F.array_distinct(F.array(block("start"), block("_to - 1")))))
    ends = rows.agg(F.min("start").alias("_first")).crossJoin(last)
    asked = refs.select("ref", F.col("ord").cast("long").alias("ord")).where("ord is not null").crossJoin(F.broadcast(ends)).where("_first <= ord")
    asked = asked.withColumn("level", F.explode(F.sequence(F.lit(1), _level(F.col("_last") - F.col("_first") + 1)))).withColumn("block", block("ord"))
    return asked.join(filed.select("path", "content", "start", "_to", "level", "block"), ["level", "block"]).where("start <= ord and ord < _to").select("ref", "path", "content")


def differences(rows: DataFrame, pairs: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """(pair, path, before, after) of what differs between the places a and b of pairs(pair, a, b); before is at a, also
    where a is the later one. Only changes between the two are looked at, never a whole snapshot."""
    bounds = rows.agg(F.min("start").alias("_first"), F.max("start").alias("_end"))
    width = F.greatest(F.lit(1), F.ceil((F.col("_end") - F.col("_first") + 1) / F.lit(blocks)))
    block = lambda at: F.floor((at - F.col("_first")) / F.col("_width"))
    one = F.broadcast(bounds.withColumn("_width", width))
    filed = rows.crossJoin(one).withColumn("block", block(F.col("start"))).select("path", "content", "before", "start", "block")
    low, high = F.least("a", "b"), F.greatest("a", "b")
    asked = pairs.where("a <> b").crossJoin(one).withColumns({"_low": F.greatest(low, F.col("_first") - 1), "_high": F.least(high, F.col("_end"))}).where("_low < _high")
    asked = asked.withColumn("block", F.explode(F.sequence(block(F.col("_low") + 1), block(F.col("_high"))))).select("pair", (F.col("a") > F.col("b")).alias("_back"), "_low", "_high", "block")
    met = asked.join(filed, "block").where("_low < start and start <= _high")
    ends = met.groupBy("pair", "_back", "path").agg(F.min_by(F.struct("before"), "start").alias("_old"), F.max_by(F.struct("content"), "start").alias("_new"))
    old, new = F.col("_old.before"), F.col("_new.content")
    return ends.where(~old.eqNullSafe(new)).select("pair", "path", F.when(F.col("_back"), new).otherwise(old).alias("before"), F.when(F.col("_back"), old).otherwise(new).alias("after"))
