"""The map of a project: what there is to say of each component, from eight tables, and the gates that need a look."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.graph import unique_owner

# The grades of gates from the weakest on.
GRADES = ("U", "D", "C", "B", "A")


def component_metrics(
    components: DataFrame, files: DataFrame, claims: DataFrame, gates: DataFrame, invariants: DataFrame, refutations: DataFrame, symbols: DataFrame, crossings: DataFrame, relies: DataFrame
) -> DataFrame:
    """components(component, …) plus, of each: files, lines and accounted files of files(path, component, lines,
    accounted); claims of claims(component, claim, inv); gates of gates(component, inv, grade, verdict), how many of each
    grade and breaches; invariants of invariants(component, inv), how many of them a claim anchors (inv: the
    invariant of a boundary claim) and how many a refutation of refutations(component, inv) has shown; symbols of
    symbols(symbol, component, documented) and the undocumented ones; guards, the symbols of crossings(symbol) that it
    alone owns, sorted; naked, how many of relies(component, via, source, target) cross between two zones by nothing.

    Every table is summed for itself before it is joined, so each join is one row for a component.
    """
    n = lambda name: F.count("*").alias(name)
    by = lambda df, *sums: df.groupBy("component").agg(*sums)
    inv = invariants.select("component", "inv").distinct()
    mark = lambda df, name: df.select("component", "inv").where("inv is not null").distinct().withColumn(name, F.lit(True))
    shown = inv.join(mark(claims, "a"), ["component", "inv"], "left").join(mark(refutations, "w"), ["component", "inv"], "left")
    guards = crossings.select("symbol").distinct().join(unique_owner(symbols), "symbol")
    sides = [
        by(files, n("files"), F.sum("lines").alias("lines"), F.count_if("accounted").alias("accounted")),
        by(claims, n("claims")),
        by(gates, n("gates"), *[F.count_if(F.col("grade") == g).alias(f"grade_{g.lower()}") for g in GRADES], F.count_if(F.col("verdict") == "fail").alias("breaches")),
        by(shown, n("invariants"), F.count("a").alias("anchored"), F.count("w").alias("witnessed")),
        by(symbols, n("symbols"), F.count_if(~F.col("documented")).alias("undocumented")),
        by(relies, F.count_if(F.col("via").isNull() & (F.col("source") != F.col("target"))).alias("naked")),
    ]
    counted = [c for s in sides for c in s.columns if c != "component"]
    owned = guards.groupBy("component").agg(F.array_sort(F.collect_list("symbol")).alias("guards"))
    rows = reduce(lambda a, b: a.join(b, "component", "left"), [*sides, owned], components)
    return rows.select(*components.columns, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counted], F.coalesce("guards", F.array().cast("array<string>")).alias("guards"))


def gates_to_see(gates: DataFrame, refutations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gates that a look is due at, one row: clean, total) of gates(component, inv, grade, verdict, reliants): what a
    machine checked and found good (A or B without a failure) is only counted. The others are plus witnessed, whether a
    refutation has shown the invariant, and place: failures first, then by grade from the weakest, then by reliants."""
    clean = F.col("grade").isin("A", "B") & (F.col("verdict") != "fail")
    weak = F.array_position(F.array(*[F.lit(g) for g in GRADES]), F.col("grade"))
    shown = refutations.select("component", "inv").distinct().withColumn("_shown", F.lit(True))
    rows = gates.where(~F.coalesce(clean, F.lit(False))).join(shown, ["component", "inv"], "left")
    order = F.struct((F.coalesce(F.col("verdict"), F.lit("")) != "fail").alias("a"), weak.alias("b"), (-F.col("reliants")).alias("c"))
    return rows.select(*gates.columns, F.coalesce("_shown", F.lit(False)).alias("witnessed"), order.alias("place")), gates.agg(F.count_if(clean).alias("clean"), F.count("*").alias("total"))
