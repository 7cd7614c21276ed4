"""Small hand-built tables with the exact rows that must come out."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from strata.functions import columns as C
from strata.functions import markdown as M
from strata.operators import ancestry, claims, graph, history, ledger, quantiles, ratchet, similarity
from strata.sources.shared import dealt


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def commit(spark, *commits):
    return spark.createDataFrame([(h, p) for h, ps in commits for p in ps], "hash string, path string")


def files(spark, **component):
    return spark.createDataFrame([(p, c, 1) for p, c in component.items()], "path string, component string, lines long")


def test_locality(spark):
    f = files(spark, a="A", b="A", c="B")
    assert rows(history.coupling(commit(spark, ("1", "abc")), f)) == [(1, 1, 2, 1 / 3)]
    assert rows(history.coupling(commit(spark), f)) == [(0, 0, 0, 1.0)]


def test_band(spark):
    names = [[f"f{i}" for i in range(n)] for n in (1, 2, 40, 41)]
    got = history.band(commit(spark, *[(str(len(x)), x) for x in names]))
    assert sorted(r.hash for r in got.collect()) == ["2", "40"]
    f = files(spark, **{f"f{i}": "A" for i in range(41)})
    assert rows(history.component_churn(commit(spark, *[(str(len(x)), x) for x in names]), f)) == [("A", 3)]


def test_spans_and_hubs(spark):
    f = files(spark, a="A", b="B", c="C", d="D", e="E")
    assert rows(history.spanning_files(commit(spark, ("1", "ab"), ("2", "acd")), f)) == [("a", 3)]
    edges = [(s, t) for s, t in ("ba", "ca", "da", "ea", "ab", "cb", "db")]
    assert rows(history.importers(spark.createDataFrame(edges, "source string, target string"), f)) == [("A", 4)]


def test_closures(spark):
    f = files(spark, a="A", b="B", c="C")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "a"), ("a", "gone")], "source string, target string")
    members = history.closure_members(commit(spark, ("1", "a"), ("2", "x"), ("3", ["a", "x"])), f, edges)
    assert rows(members) == [("1", "a"), ("1", "b"), ("3", "a"), ("3", "b")]
    specs = spark.createDataFrame([("A", 5)], "component string, spec_lines long")
    assert rows(history.closures(members, f, specs)) == [("1", 3, 7), ("3", 3, 7)]


def test_closure_sets(spark):
    """One row for each commit says what a row for each file of each closure does."""
    f = spark.createDataFrame([(f"f{i}", f"c{i % 4}" if i % 4 else None, None if i % 9 == 0 else i) for i in range(40)], "path string, component string, lines long")
    edges = spark.createDataFrame([(f"f{i * 7 % 40}", f"f{i * i % 45}") for i in range(90)], "source string, target string")
    made = spark.createDataFrame([(i % 25, f"f{i * 11 % 43}") for i in range(70)] + [(99, "f9"), (98, "gone")], "hash long, path string")
    sets, numbered, named = history.closure_sets(made, f, edges)
    members = history.closure_members(made, f, edges)
    closed = history.closures(members, f)
    assert rows(history.closure_sizes(sets)) == rows(closed)
    assert rows(history.closure_counts(sets, numbered)) == rows(history.attribution(members))
    assert rows(history.mean_closure_of_sets(sets, named, 9)) == rows(history.mean_closure(members, closed, f, 9))


@pytest.mark.parametrize("n", [0, 1, 2, 5, 10, 11])
def test_stats(spark, n):
    closed = spark.createDataFrame([(str(i), i, 2 * i) for i in range(1, n + 1)], "hash string, files long, lines long")
    xs = list(range(1, n + 1))
    median = (xs[(n - 1) // 2] + xs[n // 2]) / 2 if n else 0
    p90 = xs[-(-9 * n // 10) - 1] if n else 0
    assert rows(history.closure_stats(closed)) == [(n, median, p90, 2.0 * median, 2.0 * p90)]


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 10, 41])
def test_buckets(spark, n):
    df = spark.range(n).repartition(3)
    got = {r.id: r.bucket for r in history.buckets(df, 8, F.desc("id")).collect()}
    size = -(-n // 8)
    assert got == {i: (n - 1 - i) // size for i in range(n)}


def test_heat(spark):
    commits = commit(spark, ("1", "ab"), ("2", "ac"), ("3", "bc"), ("4", "ac"))
    symbols = spark.createDataFrame([("s", "a"), ("s", "b"), ("t", "zz")], "symbol string, path string")
    assert rows(history.crossing_heat(symbols, commits)) == [("s", 0.75), ("t", 0.0)]


def test_gestures(spark):
    commits = spark.createDataFrame([(str(i), i) for i in range(4)], "hash string, ord int")
    cf = commit(spark, ("0", "a"), ("1", "ab"), ("2", "abc"), ("3", "a"))
    deltas = spark.createDataFrame([("3", 1, 2), ("0", 2, 2)], "hash string, added int, deleted int")
    rich = history.enriched(commits, cf, files(spark, a="A", b="B", c="C"), deltas)
    assert [r.kind for r in history.gestures(rich).orderBy("ord").collect()] == ["converge", "couple", "smear", "prune"]
    assert sum(1 for _ in history.drift_windows(rich).collect()) == 3


def test_calibration(spark):
    s = [("a", 1, "defect", ["x"], ["x", "y"]), ("a", 2, "unknown", [], ["z"]), ("b", 3, "clean", ["x"], ["x"]), ("c", 4, "unknown", [], [])]
    df = spark.createDataFrame([(*r, []) for r in s], "id string, ord int, outcome string, predicted array<string>, observed array<string>, changed array<string>")
    assert rows(history.calibration(df)) == [(3, (0.5 + 1 + 0) / 3, 1 / 3, 1.0, 0.0)]
    assert rows(history.calibration(df.where("id = 'c'"))) == [(1, 0.0, 0.0, None, None)]


SAID = "one two three four five six seven eight nine ten eleven twelve thirteen"


def units(spark, *said):
    return spark.createDataFrame([(str(i), f"f{i}", s.split()) for i, s in enumerate(said)], "id string, file string, words array<string>")


def test_prose(spark):
    assert rows(similarity.prose_pairs(units(spark, SAID, SAID))) == [("0", "1", 8, 1.0, True)]
    (a, b, shared, s, same), = rows(similarity.prose_pairs(units(spark, SAID, SAID.replace("thirteen", "other"))))
    assert not same and s < 1
    assert not rows(similarity.prose_pairs(units(spark, SAID, "a b c d e f g h i j k l m")))
    assert not rows(similarity.prose_pairs(units(spark, *[SAID] * 7)))
    assert len(rows(similarity.prose_pairs(units(spark, *[SAID] * 6)))) == 15
    same_file = units(spark, SAID, SAID).withColumn("file", F.lit("f"))
    assert not rows(similarity.prose_pairs(same_file))
    assert not rows(similarity.prose_pairs(units(spark, *[" ".join(SAID.split()[:11])] * 2)))


def test_prose_moves_words_of_pairs_alone(spark):
    plan = similarity.prose_pairs(units(spark, SAID, SAID))._jdf.queryExecution().optimizedPlan().toString()
    made = [line for line in plan.splitlines() if "Generate explode" in line and "token" in line.split("[")[-1]]
    assert len(made) == 2 and all("_words" in line for line in made)


def test_prose_across_batches(spark):
    """A shingle's units are counted over batches of any size, and of frequent ones no more than needed."""
    said = [SAID] * 6 + [SAID.replace("one", "uno")] * 2 + ["a b c d e f g h i j k l"] * 40
    given, at = units(spark, *said), "spark.sql.execution.arrow.maxRecordsPerBatch"
    want, before = {(str(i), str(j)) for i in range(6) for j in range(i + 1, 6)} | {("6", "7")}, spark.conf.get(at)
    assert {r[:2] for r in rows(similarity.prose_pairs(given))} == want
    try:
        spark.conf.set(at, "2")
        assert {r[:2] for r in rows(similarity.prose_pairs(given))} == want
    finally:
        spark.conf.set(at, before)


def sites(spark, *given):
    return spark.createDataFrame([(i, n, k, f, sorted(keys), t) for i, (n, k, f, keys, t) in enumerate(given)], "id int, name string, kind string, file string, keys array<string>, type_link string")


def test_domains(spark):
    a, b = ("A", "union", "f", ["p", "q", "r", "s"], None), ("B", "list", "g", ["p", "q", "r", "t"], None)
    assert rows(similarity.domain_pairs(sites(spark, a, b))) == [(0, 1, 3, 3, 1, 1, 4.2)]
    assert not rows(similarity.domain_pairs(sites(spark, a, ("B", "list", "g", ["p", "q", "t", "u"], None))))
    tied = ("T", "table", "g", ["p", "q", "r", "s"], "A")
    assert not rows(similarity.domain_pairs(sites(spark, a, tied)))
    far = ("T", "table", "g", ["p", "q", "r", "s"], "Elsewhere")
    assert len(rows(similarity.domain_pairs(sites(spark, a, far)))) == 1
    assert not rows(similarity.domain_pairs(sites(spark, a, b), spark.createDataFrame([("B",)], "name string")))
    part = ("S", "switch", "g", ["p", "q", "r"], None)
    assert rows(similarity.domain_pairs(sites(spark, a, part))) == [(0, 1, 3, 3, 1, 0, 3.0)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dealt_by_rows(spark):
    """What is counted for each pair, or path, is dealt first, to more tasks for more rows."""
    assert dealt(spark.range(9), 9_000_001, "id").rdd.getNumPartitions() == 10
    a, b = ("A", "union", "f", ["p", "q", "r", "s"], None), ("B", "list", "g", ["p", "q", "r", "t"], None)
    assert "REPARTITION_BY_NUM" in plan_of(similarity.domain_pairs(sites(spark, a, b)))
    cf = commit(spark, ("0", "abc"), ("1", "abcd"))
    assert "REPARTITION_BY_NUM" in plan_of(history.spanning_files(cf, files(spark, a="A", b="B", c="C", d="D")))


def test_ancestry_sends_no_table_through_the_driver(spark):
    c = spark.createDataFrame([(1, []), (2, [1]), (3, [2, 1])], "hash long, parents array<long>")
    refs = c.select("hash")
    assert "BroadcastExchange" not in plan_of(ancestry.chains(c))
    places = ancestry.chains(c)
    labels = ancestry.reached(c, refs, places)
    assert "BroadcastExchange" not in plan_of(ancestry.ancestors_of(refs.withColumn("other", F.col("hash") - 1), labels, places))
    assert "BroadcastHashJoin" not in plan_of(ancestry.commits_since(c, refs, c.where("hash = 3").select("hash")))


def test_surface_delta_takes_nulls_for_equal(spark):
    said = lambda *rows: spark.createDataFrame(rows, "kind string, name string, member string")
    before, after = said(("export", "f", None), ("domain", "d", "x")), said(("export", "f", None), ("domain", "d", "x"), ("domain", "d", "y"), ("domain", "d", "y"))
    assert rows(ratchet.surface_delta(before, after)) == [(0, 0, 1)]
    assert rows(ratchet.surface_delta(after, before)) == [(0, 0, 0)]
    assert "Join" not in plan_of(ratchet.surface_delta(before, after))


def test_round_half_up_on_doubles(spark):
    assert spark.createDataFrame([(1.005,), (2.675,), (0.125,)], "x double").select(C.round2(F.col("x"))).collect() == [(1.0,), (2.68,), (0.13,)]
    assert spark.sql("select 1.005D as x").select(C.round2(F.col("x")).alias("r")).first().r == 1.0


def test_positions(spark):
    kind = "id string, at string, subject string, chose string, authority string"
    state = lambda *rs: [(r.state, r.selected) for r in ledger.positions(spark.createDataFrame([(str(i), str(i), "s", c, a) for i, (c, a) in enumerate(rs)], kind)).collect()]
    assert state(("x", None), ("x", None)) == [("aligned", "1")]
    assert state(("x", "user-directed"), ("y", "local-proposal")) == [("ratified", "0")]
    assert state(("x", "user-directed"), ("y", "user-directed")) == [("contested", None)]
    assert state(("x", None), ("y", None)) == [("needs-ratification", None)]
    assert state(("x", None), ("y", "local-proposal")) == [("needs-ratification", None)]


def test_resolve(spark):
    rs = [("h", "session", None), ("a", "decision", None), ("b", "conjecture", None), ("c", "resolution", "b"), ("d", "retraction", "c"), ("e", "dismissal", "b"), ("f", "retraction", "a"), ("g", "blocked", None), ("i", "conjecture", None)]
    df = spark.createDataFrame([(i, k, s, str(n), n) for n, (i, k, s) in enumerate(rs)] + [("g", "blocked", None, "9", 9)], "id string, kind string, supersedes string, at string, ord int")
    assert rows(ledger.resolve(df).select("id", "state", "by")) == [("a", "retracted", "f"), ("b", "dismissed", "e"), ("c", "retracted", "d"), ("g", "blocked", None), ("i", "open", None)]


def test_bands(spark):
    df = spark.createDataFrame([("m", 5.0, 0.0, 5.0), ("n", 4.9, 0.0, 5.0), ("z", 0.0, 0.0, 0.0), ("u", float("nan"), 0.0, 1.0), ("o", None, 0.0, 1.0)], "metric string, value double, baseline double, threshold double")
    prior = spark.createDataFrame([("m", "q1", None)], "metric string, open_id string, resolved_at string")
    assert {r.metric: r.action for r in ledger.observe(df, prior).collect()} == {"m": "already-open", "n": "within", "z": "open", "u": "incomparable", "o": "incomparable"}


def test_merge(spark):
    before = spark.createDataFrame([("n", "a", "pass", True, 2), ("n", "gone", "pass", False, 1), ("out", "b", "fail", True, 1)], "node string, claim string, kind string, ever_failed boolean, runs int")
    fresh = spark.createDataFrame([("n", "a", "skip"), ("n", "c", "fail")], "node string, claim string, kind string")
    scope = spark.createDataFrame([("n",)], "node string")
    assert rows(ledger.merge_claims(before, fresh, scope)) == [("n", "a", "pass", True, 2), ("n", "c", "fail", True, 1), ("out", "b", "fail", True, 1)]
    assert len(rows(ledger.merge_claims(before, fresh))) == 2


def test_replays(spark):
    df = spark.createDataFrame([("k", "a", 1), ("k", "b", 2), (None, "a", 3), (None, "a", 4)], "replay_key string, event string, ord int")
    assert rows(ledger.activity_counts(df)) == [("a", 2), ("b", 1)]


def dims(spark, *given):
    return spark.createDataFrame([(k, float(v), u) for k, v, u in given], "key string, value double, unit string")


def test_mass(spark):
    base = dims(spark, ("lines|a", 10, None), ("lines|b", 10, None))
    tolerance = spark.createDataFrame([("lines|a", 2.0)], "key string, tolerance double")
    over = lambda *g: [r[0] for r in rows(ratchet.excursions(dims(spark, *g), base, tolerance))]
    assert over(("lines|a", 12, None), ("lines|b", 3, None)) == []
    assert over(("lines|a", 12.5, None), ("lines|b", 11, None), ("lines|c", 1, None)) == ["lines|a", "lines|b", "lines|c"]


def test_reconcile(spark):
    base = dims(spark, ("lines|a", 10, None), ("lines|b", 10, None), ("files|a", 10, None))
    assert rows(ratchet.reconcile(dims(spark, ("lines|x", 10, None)), base)) == [("lines|a", "lines|x", 10.0)]
    assert rows(ratchet.reconcile(dims(spark, ("lines|x", 11, None)), base)) == []
    three = dims(spark, *[(f"lines|{k}", 10, None) for k in "zyx"])
    assert rows(ratchet.reconcile(three, base)) == [("lines|a", "lines|x", 10.0), ("lines|b", "lines|y", 10.0)]


@pytest.mark.parametrize(("exports", "variants", "loc", "anchors", "level"), [(7, 0, 399, 0, "quiet"), (8, 0, 0, 0, "alarm"), (0, 0, 400, 0, "alarm"), (12, 0, 0, 1, "quiet"), (12, 1, 0, 1, "outpacing")])
def test_novelty(spark, exports, variants, loc, anchors, level):
    df = spark.createDataFrame([(exports, variants, loc, 0, anchors)], "new_exports int, new_variants int, loc_added int, loc_deleted int, anchors_added int")
    assert ratchet.novelty(df).first().level == level


def test_prefixes(spark):
    paths = spark.createDataFrame([("a/b/c.ts",), ("a/bc.ts",), ("x.ts",)], "path string")
    dirs = spark.createDataFrame([("a",), ("a/b",), ("a/b/c",)], "dir string")
    assert rows(graph.longest_prefix(paths, dirs)) == [("a/b/c.ts", "a/b"), ("a/bc.ts", "a"), ("x.ts", None)]
    assert rows(graph.longest_prefix(paths, spark.createDataFrame([("",)], "dir string"))) == [("a/b/c.ts", ""), ("a/bc.ts", ""), ("x.ts", "")]


def test_overlaps(spark):
    given = {"a": ("src", True), "b": ("src/x.ts", False), "c": ("src/x.ts", False), "d": ("srcs", True), "e": ("src/y", True), "f": ("", True)}
    df = spark.createDataFrame([(w, b, t) for w, (b, t) in given.items()], "work string, base string, tree boolean")

    def meet(x, y):
        (a, ta), (b, tb) = given[x], given[y]
        return not a or not b or a == b or (ta and b.startswith(a + "/")) or (tb and a.startswith(b + "/"))

    assert rows(graph.overlaps(df)) == [p for p in itertools.combinations(sorted(given), 2) if meet(*p)]


def test_readiness(spark):
    works = spark.createDataFrame([("a", "completed"), ("b", "open"), ("c", "open"), ("d", "blocked"), ("e", "open"), ("f", "open"), ("g", "active")], "work string, state string")
    needs = spark.createDataFrame([("b", "a"), ("c", "b"), ("e", "d"), ("f", "nowhere")], "work string, dependency string")
    assert dict(graph.readiness(works, needs).collect()) == {"a": "done", "b": "ready", "c": "waiting", "d": "blocked", "e": "blocked", "f": "ready", "g": "active"}


def test_cycles_and_reach(spark):
    edges = spark.createDataFrame([("b", "a"), ("a", "b"), ("b", "c"), ("c", "c")], "source string, target string")
    assert rows(graph.cycles(edges)) == [(["a", "b"],), (["c"],)]
    assert rows(graph.reach(edges, spark.createDataFrame([("a",)], "node string"))) == [("a",), ("b",), ("c",)]


def walked(edges):
    """The cycles that one walk over everything finds."""
    onward, found, left = {}, set(), set()
    for s, t in sorted(set(edges)):
        onward.setdefault(s, []).append(t)

    def visit(node, path):
        for t in onward.get(node, ()):
            if t in path:
                loop = path[path.index(t) :]
                k = loop.index(min(loop))
                found.add(tuple(loop[k:] + loop[:k]))
            elif t not in left:
                visit(t, [*path, t])
        left.add(node)

    for n in sorted({x for e in edges for x in e}):
        if n not in left:
            visit(n, [n])
    return sorted(found)


@pytest.mark.parametrize("seed", range(4))
def test_cycles_by_parts_are_those_of_one_walk(spark, seed):
    rng = random.Random(seed)
    edges = [(12 * p + rng.randrange(12), 12 * p + rng.randrange(12)) for p in range(8) for _ in range(rng.randrange(2, 18))]
    got = graph.cycles(spark.createDataFrame(edges, "source long, target long"))
    assert sorted(tuple(r.cycle) for r in got.collect()) == walked(edges)
    part = {r.node: r.part for r in graph.parts(spark.createDataFrame(edges, "source long, target long")).collect()}
    for s, t in edges:
        assert part[s] == part[t] <= min(s, t)
    assert all(part[part[n]] == part[n] for n in part)


def reached(edges, seeds):
    onward = {}
    for s, t in edges:
        onward.setdefault(s, []).append(t)
    found, todo = set(seeds), list(seeds)
    while todo:
        for t in onward.get(todo.pop(), ()):
            if t not in found:
                found.add(t)
                todo.append(t)
    return found


@pytest.mark.parametrize("hops", [2])
def test_reach_contracts_what_is_far(spark, hops):
    rng = random.Random(hops)
    edges = [(i, i + 1) for i in range(60)] + [(i, 1000 + i) for i in range(0, 60, 3)]  # a chain with leaves
    edges += [(60, 200), (60, 201), *((200 + i, 202 + i) for i in range(20)), (221, 300), (220, 300), (300, 301)]  # two ways that meet again
    edges += [(400, 401), (401, 402), (402, 400), (402, 5)]  # a ring that isn't reached
    edges += [(500 + rng.randrange(20), 500 + rng.randrange(20)) for _ in range(25)] + [(301, 505)]
    df = spark.createDataFrame(edges, "source long, target long")
    for seeds in ([0], [30, 510], [9999]):
        got = [r.node for r in graph.reach(df, spark.createDataFrame([(x,) for x in seeds], "node long"), hops).collect()]
        assert len(got) == len(set(got)) and set(got) == reached(edges, seeds)


def test_reach_takes_few_rounds_for_a_long_chain(spark, monkeypatch):
    rounds, real = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label: rounds.append(label) or real(df, label))
    line = spark.range(5000).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    assert graph.reach(line, spark.createDataFrame([(0,)], "node long"), 4).count() == 5001
    assert len(rounds) < 40


def test_exact_quantiles(spark):
    rng = random.Random(5)
    sets = [[rng.gauss(0, 1) for _ in range(900)], [rng.paretovariate(0.3) for _ in range(900)], [float(rng.randrange(3)) for _ in range(900)], [7.0] * 50, [1.5], [1.0] * 400 + [2.0] + [3.0] * 400]
    shares = [0.0, 0.01, 0.25, 1 / 3, 0.5, 0.9, 0.999, 1.0]
    for values in sets:
        df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double")
        s, n = sorted(values), len(values)
        for p, between, nearest in quantiles.quantiles(df, "v", shares, kept=20):
            at = p * (n - 1)
            a, b = s[math.floor(at)], s[math.ceil(at)]
            assert between == pytest.approx(a + (b - a) * (at - math.floor(at)), rel=1e-12)
            assert nearest == s[max(0, math.ceil(p * n) - 1)]
    assert quantiles.quantiles(df.limit(0), "v", [0.5]) == [(0.5, None, None)]


def test_edges_that_lead_one_way(spark):
    df = lambda e: spark.createDataFrame(e, "source string, target string")
    assert graph._one_way(df([("10", "9"), ("9", "1")])) and graph._one_way(df([("a", "b"), ("b", "c")]))
    assert not graph._one_way(df([("a", "b"), ("c", "b")]))
    assert graph.cycles(df([("10", "9"), ("9", "9")])).collect()[0].cycle == ["9"]


def test_first_candidate(spark):
    df = spark.createDataFrame([("m.ts", "./x", ["x.js", "x.ts", "m.ts"]), ("m.ts", "./m", ["m.ts"])], "source string, spec string, candidates array<string>")
    paths = spark.createDataFrame([("x.ts",), ("m.ts",)], "path string")
    assert rows(graph.first_candidate(df, paths)) == [("m.ts", "./x", "x.ts")]


def test_selection_ignores_order(spark):
    seen = [("r1", "k", "redirect"), ("r2", "k", "require-decision"), ("r3", "k", "release")]
    rules = spark.createDataFrame([("r1", 0), ("r2", 1), ("r3", 2)], "rule string, ord int")
    pick = lambda o: tuple(claims.select_action(spark.createDataFrame(o, "rule string, key string, action string"), rules).first())
    assert {pick(list(p)) for p in itertools.permutations(seen)} == {("require-decision", "r2", "k")}
    assert pick([*seen, ("r1", "k", "release")])[0] == "refuse"
    assert pick([("r9", "k", "release")])[0] == "refuse"
    assert pick([("r3", "k", "release")]) == ("release", None, None)


def test_oracles(spark):
    results = spark.createDataFrame([("suite > a b", "passed", 5.0), ("suite > a c", "failed", 7.0), ("suite > d", "skipped", None)], "full_name string, status string, duration double")
    names = spark.createDataFrame([("a b",), ("a",), ("d",), ("zz",)], "name string")
    assert rows(claims.oracle_results(names, results)) == [("a b", "pass", 5.0), ("a", "fail", 12.0), ("d", "none-ran", None), ("zz", "vanished", None)]


def test_fitting_prefix(spark):
    df = spark.createDataFrame([("d", i, 10) for i in range(5)], "doc string, ord int, bytes int")
    kept = lambda b: len(claims.fitting_prefix(df, b, 4).collect())
    assert [kept(b) for b in (9, 14, 15, 49, 50)] == [0, 0, 1, 4, 5]


TEXT = "# T\n\nOne line\nand more. Next one!\n\n```\ncode\n```\n- item\n| a | b |\n|---|---|\n| `x` | 1 |\n| y | 2 |\n| z | 3 |\nsee `p|q|r` now\n"


def test_markdown(spark):
    df = spark.createDataFrame([("f", TEXT)], "file string, text string")
    assert [tuple(r) for r in M.units(df).orderBy("line").collect()] == [("f", 3, "One line and more."), ("f", 3, "Next one!"), ("f", 9, "item"), ("f", 15, "see `p|q|r` now")]
    assert rows(M.domain_sites(df)) == [("f", "alternation", ["p", "q", "r"]), ("f", "md-table", ["x", "y", "z"])]


def test_spec(spark):
    text = "# Core\n\n## intent\nDo it.\n\n## claims\n- a \\_b\\_ imports c\n- lives in z\n\n## refutations\n- inv one: seen\n"
    r = spark.createDataFrame([(text,)], "t string").select(M.spec(F.col("t")).alias("s")).select("s.*", M.refuted(F.col("s.refutations")).alias("r")).first()
    assert (r.name, r.intent, r.claims, r.invariants, r.r) == ("Core", "Do it.", ["a _b_ imports c", "lives in z"], [], ["inv one"])


def test_regions(spark):
    df = spark.createDataFrame([("x <a>old</a> y",), ("none",)], "t string")
    t = F.col("t")
    assert rows(df.select(M.splice(t, F.lit("NEW"), "<a>", "</a>"), M.extract(t, "<a>", "</a>"))) == [("x NEW y", "<a>old</a>"), (None, None)]


def test_columns(spark):
    df = spark.createDataFrame([("a.b", "kind:id:x", [1.0, 2.0, 3.0])], "s string, ref string, v array<double>")
    r = df.select(C.slug(F.col("s")).alias("a"), C.slug(F.lit("a b/c")).alias("b"), C.ref_parts(F.col("ref")).alias("p"), C.sparkline(F.col("v"), F.lit(1.0), F.lit(3.0)).alias("k"), C.trend(F.lit(1.0), F.lit(1.05), 0.03).alias("t"), C.heat_cell(F.lit(None).cast("double"), F.lit(1.0)).alias("h")).first()
    assert (r.a, tuple(r.p), r.k, r.t, r.h) == ("a.b", ("kind", "id:x"), "▁▅█", "▲", "") and r.b.startswith("a-b-c-")


def test_globs():
    import re

    assert re.match(C.glob_regex("src/*.ts"), "src/a.ts") and not re.match(C.glob_regex("src/*.ts"), "src/b/a.ts")
    assert re.match(C.glob_regex("src/**.ts"), "src/b/a.ts") and not re.match(C.glob_regex("a.c"), "abc")


def test_doubts(spark):
    from strata.operators import activity

    df = spark.createDataFrame([(["the decoder broke"],), (["the decoder is fine"],), (["[instrument] off"],), (["weather"],)], "c array<string>")
    assert [r[0] for r in df.select(activity.doubts_apparatus(F.get("c", F.lit(0)))).collect()] == [True, False, True, False]
    assert [len(r[0]) for r in df.select(activity.with_doubt(F.col("c"))).collect()] == [2, 2, 1, 2]


def test_commands(spark):
    from strata.operators import activity

    said = ["tool verify", "npx tool regulate --x=1", "tool verify | cat", "echo tool verify", "tool other", ' tool verify', "tool verify\nrm"]
    df = spark.createDataFrame([(c,) for c in said], "c string").select(F.to_json(F.struct(F.lit("Bash").alias("tool_name"), F.struct(F.col("c").alias("command")).alias("tool_input"))).alias("p"))
    assert [r[0] for r in df.select(activity.command(F.col("p"), "tool")["name"]).collect()] == ["verify", "regulate", None, None, None, None, None]


def test_identity(spark):
    from strata.operators import activity

    df = spark.createDataFrame([("s", "e", "t1", None), ("s", "e", "t1", None), ("s", "e", "t2", None), ("s", "e", None, None)], "s string, e string, t string, u string")
    ids = [r[0] for r in df.select(activity.event_identity(F.col("s"), F.col("e"), F.col("t"), F.col("u"))).collect()]
    assert ids[0] == ids[1] != ids[2] and ids[3] is None and len(ids[0]) == 18
    keys = [r[0] for r in df.select(activity.replay_key(F.col("t"), F.col("u"))).collect()]
    assert keys[0] == keys[1] != keys[2] and keys[3] is None


def test_reach_has_no_bound(spark):
    from strata.operators import graph

    edges = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(70, 3), (100, 101)], "source long, target long").coalesce(1)
    got = graph.reach(edges, spark.createDataFrame([(0,)], "node long").coalesce(1)).collect()
    assert sorted(r.node for r in got) == list(range(71))
