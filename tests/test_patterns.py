"""Names in texts and globs against paths, each against the plain way."""

import random
import re

from strata.functions.columns import glob_regex
from strata.operators import globs as G
from strata.operators import patterns as P


def test_containing(spark):
    rng = random.Random(2)
    alphabet = "aab\U0001f600é /"
    some = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    texts = [None, "", "a", *(some(rng.randrange(300)) for _ in range(120))]
    names = [None, "", "a", "b", "\U0001f600", "nowhere", *(some(rng.randrange(1, 6)) for _ in range(60)), *(t[3:203] for t in texts if t and len(t) > 210)]
    want = {(n, t) for n in names if n for t in texts if t and n in t}
    df = lambda rows, c: spark.createDataFrame([(r,) for r in [*rows, *rows]], f"{c} string")
    for how in ({}, {"automaton": 200, "group": 2000}):
        rows = P.containing(df(names, "name"), df(texts, "text"), **how).collect()
        assert len(rows) == len(want) and {(r.name, r.text) for r in rows} == want
    assert P.containing(df([], "name"), df(texts, "text")).count() == 0 and P.containing(df(names, "name"), df([], "text")).count() == 0


def test_many_names_join_pieces(spark):
    """Many names of few lengths meet pieces of texts, not automata, with the same result."""
    from unittest import mock

    rng = random.Random(28)
    some = lambda n: "".join(rng.choice("ab\U0001f600é") for _ in range(n))
    texts = [None, "", "a", "aaaaaaa", *(some(rng.randrange(60)) for _ in range(80)), some(3000)]
    names = [None, "", *(some(rng.randrange(1, 7)) for _ in range(400)), "nowhere"]
    want = {(n, t) for n in names if n for t in texts if t and n in t}
    df = lambda rows, c: spark.createDataFrame([(r,) for r in [*rows, *rows]], f"{c} string")
    with mock.patch.object(P, "_find", side_effect=AssertionError("automata")), mock.patch.object(P, "_by_pieces", wraps=P._by_pieces) as pieces:
        rows = P.containing(df(names, "name"), df(texts, "text"), automaton=20).collect()
    assert pieces.call_count == 1 and len(rows) == len(want) and {(r.name, r.text) for r in rows} == want


def test_loads_lose_no_text():
    texts = [b"x" * n for n in (0, P.LOAD - 1, 1, 1, 2 * P.LOAD, 0, 5)]
    assert [i for start, upto in P._loads(texts) for i in range(start, upto)] == list(range(len(texts))) and list(P._loads([])) == [(0, 0)]


def test_globs(spark):
    rng = random.Random(4)
    parts = ["a", "b", "ab", "a.ts", "b.ts", "", "*", "**", "*.ts", "a*", "?", "?b", "a?", "a**b", "**.ts", "a**", "*a*b*", "***", "?*"]
    globs = sorted({"/".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) for _ in range(150)}) + ["a/**", "**", "a/b", "", "(a+b).[t]s", "=a", "*any"]
    names = ["a", "b", "ab", "aab", "a.ts", "b.ts", "", "xa.ts", "(a+b).[t]s", "=a", "*any"]
    paths = sorted({"/".join(rng.choice(names) for _ in range(rng.randrange(1, 6))) for _ in range(150)})
    want = {(p, i) for i, g in enumerate(globs) for r in [re.compile(glob_regex(g))] for p in paths if r.match(p)}
    df = spark.createDataFrame([(p,) for p in [*paths, *paths, None]], "path string")
    rows = G.matching(df, globs).collect()
    assert len(rows) == len(want) and {(r.path, r.number) for r in rows} == want
    first = {}
    for p, i in want:
        first[p] = min(i, first.get(p, i))
    assert {r.path: r.number for r in G.first_match(df, globs).collect()} == first
    assert G.matching(df.limit(0), globs).count() == 0
