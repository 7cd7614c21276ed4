"""Versions against replays of the log, and ancestry against a closure, on random histories."""

import random

from pyspark.sql import functions as F

from strata.operators import ancestry as A
from strata.operators import versions as V

SCHEMA = "path string, ord long, content string"


def log(rng, n=400, paths=12, places=90):
    return [(rng.choice([f"p{i}" for i in range(paths)] + [None]), rng.choice([*range(-20, places), None]), rng.choice(["a", "b", "c", None, ""])) for _ in range(n)]


def replay(changes, at):
    best = {}
    for path, ord_, content in changes:
        if path is not None and ord_ is not None and ord_ <= at:
            key = (ord_, content is not None, content or "")
            if path not in best or key > best[path][0]:
                best[path] = (key, content)
    return {p: c for p, (_, c) in best.items() if c is not None}


def test_snapshots_and_differences(spark):
    rng = random.Random(3)
    changes = log(rng)
    df = spark.createDataFrame(changes, SCHEMA)
    asked = [-30, -20, -1, 0, 1, 7, 31, 32, 33, 64, 89, 90, 1000]
    refs = spark.createDataFrame([(f"r{i}", o) for i, o in enumerate(asked)] + [("none", None)], "ref string, ord long")
    pairs = [(a, b) for a in asked for b in asked]
    both = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, a long, b long")
    for stretch in (1, 1 << 16):
        rows = V.versions(df, stretch).persist()
        got = {}
        for r in V.at_refs(rows, refs).collect():
            assert (r.ref, r.path) not in got
            got[r.ref, r.path] = r.content
        assert got == {(f"r{i}", p): c for i, o in enumerate(asked) for p, c in replay(changes, o).items()}
        for r in rows.collect():
            assert (r.end is None or r.start < r.end) and r.content != r.before
        for blocks in (5, 4096):
            found = {(r.pair, r.path): (r.before, r.after) for r in V.differences(rows, both, blocks).collect()}
            want = {}
            for i, (a, b) in enumerate(pairs):
                x, y = replay(changes, a), replay(changes, b)
                want |= {(i, p): (x.get(p), y.get(p)) for p in {*x, *y} if x.get(p) != y.get(p)}
            assert found == want
    empty = V.versions(df.limit(0))
    assert V.at_refs(empty, refs).count() == 0 and V.differences(empty, both).count() == 0
    assert V.at_refs(rows, refs.limit(0)).count() == 0


def merges(rng, n):
    """Commits whose first parent is often the one before, with merges, lost parents and several roots."""
    out = []
    for i in range(n):
        parents = []
        if i and rng.random() < 0.95:
            parents.append(i - 1 if rng.random() < 0.6 else rng.randrange(i))
        if i > 2 and rng.random() < 0.3:
            parents += rng.sample(range(i), rng.randrange(1, 3))
        if rng.random() < 0.05:
            parents.append(10_000 + i)
        out.append((i, parents))
    return out


def closure(commits):
    up = dict(commits)
    reach = {}
    for i, parents in commits:
        reach[i] = {i}.union(*(reach[p] for p in parents if p in up))
    return reach


def test_ancestry_equals_a_closure(spark):
    commits = merges(random.Random(6), 90)
    df = spark.createDataFrame(commits, "hash long, parents array<long>")
    places = A.chains(df).persist()
    rows = {r.hash: (r.chain, r.pos) for r in places.collect()}
    assert len(rows) == 90 and len(set(rows.values())) == 90
    reach = closure(commits)
    labels = A.reached(df, df.select("hash"), places).persist()
    pairs = spark.createDataFrame([(i, j) for i in [*range(90), 777] for j in [*range(90), 888]], "hash long, other long")
    got = {(r.hash, r.other): r["is"] for r in A.ancestors_of(pairs, labels, places).collect()}
    assert got == {(i, j): (j in reach[i]) if i < 90 and j < 90 else None for i in [*range(90), 777] for j in [*range(90), 888]}
    since = {r.hash: r.n for r in A.commits_since(df, spark.createDataFrame([(i,) for i in [*range(90), 777]], "hash long"), spark.createDataFrame([(70,)], "hash long")).collect()}
    assert since == {i: len(reach[70] - reach[i]) if i in reach[70] else None for i in [*range(90), 777]}


def test_a_long_chain_takes_few_rounds(spark):
    n = 3000
    line = spark.range(n).select(F.col("id").alias("hash"), F.when(F.col("id") > 0, F.array(F.col("id") - 1)).otherwise(F.array().cast("array<long>")).alias("parents"))
    places = A.chains(line)
    assert places.agg(F.count_distinct("chain"), F.max("pos")).first()[:] == (1, n - 1)
