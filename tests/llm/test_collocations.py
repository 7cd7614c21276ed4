"""Phrase counts and collocations against plain versions written here."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from strata.llm import collocations as co

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(rows, max_n=4, floor=1):
    out = Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            out[lang, "", 0] += len(w)
            for n in range(1, max_n + 1):
                for i in range(len(w) - n + 1):
                    out[lang, " ".join(w[i : i + n]), n] += 1
    return {k: v for k, v in out.items() if (k[2] == 0 and v) or (k[2] and v >= floor)}


def brute(rows, max_n=4, floor=3, inside=80, first=2000):
    f = brute_counts(rows, max_n)
    out = []
    for lang in {k[0] for k in f}:
        mine = {k[1]: v for k, v in f.items() if k[0] == lang and k[2]}
        found = []
        candidates = {p: a for p, a in mine.items() if " " in p and a >= floor}
        for p, a in candidates.items():
            w = p.split(" ")
            if any(len(q.split(" ")) > len(w) and f" {p} " in f" {q} " and 100 * b >= inside * a for q, b in candidates.items()):
                continue
            score, _, l, r = min((2_000_000 * a // (mine[" ".join(w[:k])] + mine[" ".join(w[k:])]), k, mine[" ".join(w[:k])], mine[" ".join(w[k:])]) for k in range(1, len(w)))
            found.append((-score, -a, p.encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, f[lang, "", 0], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:first], 1)]
    return sorted(out)


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    words = ["a", "b", "B", "é", "\U0001f600", "ÀB", "x-y", "z\x00", "w'"] + [f"v{i}" for i in range(30)]
    rows = [(None, None), (None, ""), ("en", " \t\n"), ("", "one two three"), ("a\nb", "odd name of a language"), ("en", "...,,"), ("en", "a\x0bb\x0cc\rd"), ("en", "a  b\ta b")]
    for _ in range(n):
        rows.append((rng.choice(["en", "en", "de", None]), "".join(rng.choice(words)[: rng.randrange(1, 4)] + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", ""]) for _ in range(rng.randrange(60)))))
    return rows + [("en", "hot pair " * 200)] * 3 + [("en", "hot pair and others follow it")] * 40


def frame(spark, rows):
    return spark.createDataFrame([(t, lang, 1) for lang, t in rows], "text string, lang string, f int").repartition(5)


@pytest.mark.parametrize("how", [{}, {"share": 0}, {"share": 1.0, "buckets": 40}, {"share": 1.0, "buckets": 61, "fan": 3}, {"buckets": 1}])
def test_counts(spark, how):
    rows = corpus()
    for floor in (1, 4):
        got = {(r.lang, r.phrase, r.words): r.f for r in co.phrase_counts(frame(spark, rows), floor=floor, **how).collect()}
        assert got == brute_counts(rows, floor=floor)


@pytest.mark.parametrize("how", [{}, {"max_n": 3, "inside": 50, "first": 5}, {"max_n": 2}])
def test_collocations(spark, how):
    rows = corpus(2)
    got = sorted(tuple(r) for r in co.collocations(frame(spark, rows), floor=3, **how).collect())
    assert got == brute(rows, floor=3, **how)


def test_empty_table(spark):
    assert co.collocations(frame(spark, [("en", "x")]).limit(0)).count() == 0
    assert co.collocations(frame(spark, [(None, None)])).count() == 0


def test_frequent_prefixes_are_dealt_by_more_words(spark):
    rows = [("en", f"the next w{i} w{i % 7}") for i in range(2000)]
    texts = frame(spark, rows).select("lang", "text")
    hot = co.frequent_prefixes(texts, 4, 50, 1.0)
    assert [len(x) > 0 for x in hot] == [True, True, False]
    one = next(co._slices(iter([texts.toArrow().combine_chunks().to_batches()[0]]), 4, 1 << 22)).merged()
    batch = one.dealt(50, 1, hot)
    sizes = [int(np.frombuffer(x, np.uint32, 1)[0]) for x in batch.column(2).to_pylist()]
    assert len(sizes) > 40 and max(sizes) < 0.2 * sum(sizes)
    assert max(int(np.frombuffer(x, np.uint32, 1)[0]) for x in one.dealt(50, 1, []).column(2).to_pylist()) >= 0.25 * sum(sizes)


def test_long_texts_are_cut_between_pieces():
    rng = random.Random(9)
    text = "".join(rng.choice(["ab", "c", "dé"]) + rng.choice([" ", " ", " ", ". ", "\n"]) for _ in range(4000))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["en", "en", None]), pa.array(["x y", text, "no end " * 500])], ["lang", "text"])
    whole = next(co._slices(iter([batch]), 4, 1 << 30)).merged()
    parts = list(co._slices(iter([batch]), 4, 1000))
    assert len(parts) > 10
    together = co.Suffixes.of_loads([x for s in parts for x in s.merged().dealt(1, 1, []).column(2).to_pylist()]).merged()
    alone = co.Suffixes.of_loads(whole.dealt(1, 1, []).column(2).to_pylist()).merged()
    assert together.said == alone.said and (together.rows == alone.rows).all() and (together.counts == alone.counts).all()


def test_stack_in_chunks():
    rng = np.random.default_rng(4)
    rows = rng.integers(0, 4, (500, 3)).astype(np.uint32) + np.array([1, 0, 0], np.uint32)
    rows = rows[np.lexsort(rows.T[::-1])[::-1]]
    counts = rng.integers(1, 9, 500)
    for size in (1, 7, 500):
        stack, got = co.Stack(3), Counter()
        for a in range(0, 500, size):
            for c, (prefixes, n) in enumerate(stack.push(rows[a : a + size], counts[a : a + size])):
                for p, x in zip(prefixes.tolist(), n.tolist(), strict=True):
                    got[tuple(p[: c + 1])] += x
        for c, (prefixes, n) in enumerate(stack.close()):
            got[tuple(prefixes[0].tolist()[: c + 1])] += int(n[0])
        want = Counter()
        for r, n in zip(rows.tolist(), counts.tolist(), strict=True):
            for c in range(3):
                want[tuple(r[: c + 1])] += n
        assert {k: v for k, v in got.items() if v} == dict(want)
