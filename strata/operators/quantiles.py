"""Exact quantiles of values that no task has to hold.

A rank is sought by rounds of range counts: a sketch names two values around it, one pass counts what lies
below, between and above, and the next round looks at what the rank turned out to be in. A range of few rows
is sorted as it is. Nothing but counts, bounds and that range reaches the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a range that are sorted at once.
KEPT = 4096


def at_rank(values: DataFrame, rank: int, n: int, low: float, high: float, kept: int = KEPT) -> float:
    """The value at a rank from 0 of values(v), n numbers between low and high."""
    below = 0  # values under low
    while low < high:
        inside = values.where((F.col("v") >= low) & (F.col("v") <= high))
        if n <= kept:
            return sorted(r.v for r in inside.collect())[rank - below]
        share = (rank - below + 0.5) / n
        one, two = inside.agg(F.percentile_approx("v", [max(0.0, share - 1e-3), min(1.0, share + 1e-3)], 10_000)).first()[0]
        v = F.col("v")
        c = inside.agg(F.count_if(v < one).alias("under"), F.count_if(v == one).alias("one"), F.count_if((v > one) & (v < two)).alias("mid"), F.count_if((v == two) & F.lit(two > one)).alias("two"),
                       F.max(F.when(v < one, v)).alias("before"), F.min(F.when(v > two, v)).alias("after"), F.min(F.when((v > one) & (v < two), v)).alias("first"), F.max(F.when((v > one) & (v < two), v)).alias("last")).first()
        at = rank - below
        if at < c.under:
            n, high = c.under, c.before
        elif at < c.under + c.one:
            return one
        elif at < c.under + c.one + c.mid:
            below, n, low, high = below + c.under + c.one, c.mid, c.first, c.last
        elif at < c.under + c.one + c.mid + c.two:
            return two
        else:
            gone = c.under + c.one + c.mid + c.two
            below, n, low = below + gone, n - gone, c.after
    return low


def quantiles(rows: DataFrame, value: str, shares: list[float], kept: int = KEPT) -> list[tuple[float, float | None, float | None]]:
    """(share, between, nearest) for each share of rows' values: the quantile between the two nearest ranks, and
    the value at the nearest rank. Nulls and what isn't a number play no part; both are null without a value."""
    values = rows.select(F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    n, low, high = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
    known: dict[int, float] = {}

    def at(rank: int) -> float:
        if rank not in known:
            known[rank] = at_rank(values, rank, n, low, high, kept)
        return known[rank]

    out = []
    for p in shares:
        if not n:
            out.append((p, None, None))
            continue
        place = p * (n - 1)
        a, b = at(math.floor(place)), at(math.ceil(place))
        out.append((p, a + (b - a) * (place - math.floor(place)) if b != a else a, at(max(0, math.ceil(p * n) - 1))))
    return out
