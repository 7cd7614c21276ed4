"""Sets of numbers as bytes."""

import random

from pyspark.sql import functions as F

from strata.functions import packed as P


def test_packed_lists_come_back_as_one(spark, monkeypatch):
    """All numbers of a row's lists, each once and in order: long steps, empty lists, rows without any, and many short reads."""
    rnd = random.Random(7)
    for low in (0, 28):
        monkeypatch.setattr(P, "_STEP", 40)
        top = 1 << (62 if low else 40)
        lists = [(i % 30, [rnd.randrange(rnd.choice((3, 300, top))) for _ in range(rnd.choice((0, 1, 5, 60)))]) for i in range(200)] + [(30, [0, top - 1, 0]), (31, [])]
        rows = spark.createDataFrame(lists, "k int, xs array<bigint>").repartition(3)
        got = rows.select("k", P.packed(low)("xs").alias("p")).groupBy("k").agg(F.collect_list("p").alias("ps")).unionByName(spark.createDataFrame([(99, [])], "k int, ps array<binary>")).select("k", P.united(low)("ps").alias("xs"))
        wanted = {k: sorted({x for i, xs in lists if i == k for x in xs}) for k, _ in lists} | {99: []}
        assert {r.k: r.xs for r in got.collect()} == wanted


def test_closures_of_packed_neighbours(spark):
    """A neighbour travels as some three bytes, and closures are those of rows for each file."""
    from strata.operators import history as H

    rnd = random.Random(9)
    many = sorted(rnd.sample(range(360_000), 30))
    row = spark.createDataFrame([([x << 28 | x % 50 for x in many],)], "xs array<bigint>")
    assert row.select(F.length(P.packed(28)("xs")).alias("n")).first().n <= 3.5 * len(many)
    files = spark.createDataFrame([(f"f{i}", f"c{i % 4}" if i % 5 else None, i if i % 7 else None) for i in range(40)], "path string, component string, lines long")
    imports = spark.createDataFrame([(f"f{rnd.randrange(45)}", f"f{rnd.randrange(45)}") for _ in range(90)], "source string, target string")
    touched = spark.createDataFrame([(rnd.randrange(25), f"f{rnd.randrange(45)}") for _ in range(80)], "hash long, path string")
    sets, numbered, _ = H.closure_sets(touched, files, imports)
    members = H.closure_members(touched, files, imports)
    own = lambda df: sorted(map(tuple, df.collect()))
    assert own(H.closure_sizes(sets)) == own(H.closures(members, files)) and own(H.closure_counts(sets, numbered)) == own(H.attribution(members))
    commits = spark.createDataFrame([(i, i) for i in range(25)], "hash long, ord long")
    assert H.closure_series(H.closure_sizes(sets), commits).agg(F.count("*").alias("n")).first().n == 8


def test_series_makes_closures_once(spark):
    """Sorting by range looks at its rows before it deals them, and closures aren't made twice for that."""
    from strata.operators import history as H

    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    closed = spark.range(40, numPartitions=2).select(F.col("id").alias("hash"), F.lit(3).cast("long").alias("files")).mapInArrow(count, "hash long, files long")
    assert len(H.closure_series(closed, spark.range(40).select(F.col("id").alias("hash"), F.col("id").alias("ord"))).collect()) == 8
    assert made.value == 40
