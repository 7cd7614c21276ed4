"""Near-duplicate classes and substring dedup against plain versions written here."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa

from strata.llm import neardup, substrings, words
from strata.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = [f"w{i}" for i in range(3000)]


def prose(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def edited(rng, ws, n):
    ws = list(ws)
    for _ in range(n):
        ws[rng.randrange(len(ws))] = rng.choice(VOCABULARY)
    return ws


def fixture(rng):
    base = [prose(rng, 120) for _ in range(4)]
    texts = [" ".join(b) for b in base]
    for b in base[:3]:
        texts += [" ".join(edited(rng, b, rng.randrange(1, 5))) for _ in range(15)]
        texts += ["  ".join(b) + "\n"] * 3
    texts += [" ".join(prose(rng, 40)) for _ in range(10)] + [None, "", "  \n", "one two", "one two", "three", "é b é", "x " * 300]
    passage = " ".join(prose(rng, 30))
    texts += [" ".join(prose(rng, 20)) + "\t" + passage + " " + " ".join(prose(rng, 9)) for _ in range(6)]
    rng.shuffle(texts)
    return texts


def shingle_set(text):
    w = WORDS.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_classes(texts):
    sets, up = [shingle_set(t) for t in texts], list(range(len(texts)))

    def root(i):
        return i if up[i] == i else root(up[i])

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a and b and len(a & b) >= 0.8 * len(a | b):
            x, y = sorted((root(i), root(j)))
            up[y] = x
    return [root(i) for i in range(len(texts))]


def table(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, nd_class string").repartition(5)


def test_classes(spark):
    texts = fixture(random.Random(1))
    for how in ({}, {"block_texts": 4}, {"block_words": 500}):
        out = dict(neardup.near_duplicates(table(spark, texts), **how).collect())
        assert [out[i] for i in range(len(texts))] == brute_classes(texts), how


def test_classes_of_odd_rows(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (5, "a b c d e f"), (6, None), (7, "")]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.nd_class or 0) for r in out) == [(0, 0), (3, 3), (3, 3), (5, 3), (6, 6), (7, 7)]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(none).count() == 0
    assert substrings.dedup_substrings(none).count() == 0


def test_registers_estimate_probability_jaccard():
    rng = random.Random(4)
    a = prose(rng, 300)
    for edits in (3, 12, 40):
        texts = [" ".join(a), " ".join(edited(rng, a, edits))]
        s, owner, _, _ = neardup.shingles(pa.array(texts), 5)
        got = neardup.prob_minhash(s, owner, 2, 2048)
        sets = [shingle_set(t) for t in texts]
        want = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        assert abs((got[0] == got[1]).mean() - want) < 0.05


def test_heavier_shingles_win_more():
    # 4 heavy, 40 light elements: shares of registers follow the weights.
    s = np.r_[np.repeat(np.arange(4), 20), np.arange(4, 44)].astype(np.uint64) << np.uint64(24)
    got = neardup.prob_minhash(words.mix(s) << np.uint64(20), np.zeros(len(s), np.int64), 1, 4096)[0]
    share = np.sort(np.unique(got, return_counts=True)[1])[::-1] / 4096
    weight = 1 + np.log(20)
    assert abs(share[:4].sum() - 4 * weight / (4 * weight + 40)) < 0.05


def repetitive(rng, n, edits=0):
    """n pairs of texts that differ in how often a passage is repeated, the second of each also in `edits` words."""
    out = []
    for _ in range(n):
        a = prose(rng, 100)
        out += [" ".join(a), " ".join(edited(rng, a, edits) + a[-20:] * 49)]
    return out


def test_registers_agree_by_the_similarity_that_is_verified():
    rng = random.Random(6)
    for edits in (0, 1, 3):
        texts = repetitive(rng, 1, edits)
        s, owner, _, _ = neardup.shingles(pa.array(texts), 5)
        got = neardup.prob_minhash(s, owner, 2, 4096, counted=False)
        sets = [shingle_set(t) for t in texts]
        assert abs((got[0] == got[1]).mean() - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 0.05


def test_classes_of_repeated_passages(spark):
    texts = repetitive(random.Random(7), 60) + repetitive(random.Random(8), 60, 1)
    out = dict(neardup.near_duplicates(table(spark, texts)).collect())
    assert [out[i] for i in range(len(texts))] == brute_classes(texts)


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(40)] + [(500, k) for k in range(501, 600)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    up = {}

    def root(i):
        return i if up.setdefault(i, i) == i else root(up[i])

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    assert got == {i: root(i) for i in up}


def brute_removed(rows, width=13):
    docs = [(i, WORDS.findall(t or "")) for i, t in rows]
    least = {}
    for i, w in docs:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, w in docs:
        gone = {k + x for k in range(len(w) - width + 1) if least[tuple(w[k : k + width])] < i for x in range(width)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def test_substrings(spark):
    texts = fixture(random.Random(2))
    rows = [(i - 40, t) for i, t in enumerate(texts)] + [(-40, texts[0])]
    df = spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], "doc_id long, text string, sd_block string, sd_kept string, c0 string, sd_load int")
    out = substrings.dedup_substrings(df)
    assert out.columns == ["doc_id", "text", "sd_block", "c0", "sd_load", "sd_n_words", "sd_n_removed", "sd_spans", "sd_kept"]
    assert {(r.sd_block, r.c0, r.sd_load) for r in out.collect()} == {("x", "z", 1)}
    assert sorted((r.doc_id, r.sd_n_words, r.sd_n_removed, r.sd_kept) for r in out.collect()) == brute_removed(rows)
    assert all(sum(s.end - s.first for s in r.sd_spans) == r.sd_n_removed for r in out.collect())


def test_substrings_of_random_words(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(60)))) for i in range(60)]
    out = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.sd_n_words, r.sd_n_removed, r.sd_kept) for r in out.collect()) == brute_removed(rows)


def test_repeats_are_maximal(spark):
    """What is taken of a text is what an outward comparison, word by word, with each earlier text finds."""
    rng = random.Random(11)
    shared = prose(rng, 400)
    texts = []
    for _ in range(40):
        a = rng.randrange(360)
        texts.append(prose(rng, rng.randrange(12)) + shared[a : a + rng.randrange(5, 60)] + prose(rng, rng.randrange(12)))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: [(s.first, s.end) for s in r.sd_spans] for r in substrings.dedup_substrings(df).collect()}
    for i, w in enumerate(texts):
        gone = set()
        for v in texts[:i]:
            for p, q in itertools.product(range(len(w)), range(len(v))):
                if w[p] == v[q] and (p == 0 or q == 0 or w[p - 1] != v[q - 1]):
                    n = 0
                    while p + n < len(w) and q + n < len(v) and w[p + n] == v[q + n]:
                        n += 1
                    if n >= 13:
                        gone.update(range(p, p + n))
        assert {k for a, b in got[i] for k in range(a, b)} == gone
        assert all(b < c for (_, b), (c, _) in itertools.pairwise(got[i]))


def test_buckets_cover_all_hashes_in_order():
    keys = np.sort(np.random.default_rng(0).integers(0, 1 << 64, 5000, dtype=np.uint64))
    for n in (1, 7, 4096, 1_000_003):
        of = substrings._bucket(keys, n)
        assert (np.diff(of.astype(np.int64)) >= 0).all() and of.max() < n
    assert substrings._sent(3, keys, 50).column("sd_bucket").to_pylist() == list(range(50))


def test_null_ids_take_no_part(spark):
    t = " ".join(map(str, range(20)))
    out = substrings.dedup_substrings(spark.createDataFrame([(None, t), (1, t), (2, t)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.sd_n_removed) for r in out) == [(0, 0), (1, 0), (2, 20)]


def test_word_hashes():
    texts = ["a b\x0bc", "", None, "b", " b  ", " ", "ab", "a" * 3000 + " " + "b" * 3000]
    h, n = words.word_hashes(*words.text_bytes(pa.array(texts)))
    want = [w for t in texts for w in WORDS.findall(t or "")]
    assert n.tolist() == [len(WORDS.findall(t or "")) for t in texts]
    assert len(set(h.tolist())) == len(set(want)) and len(h) == len(want)
    h2, _ = words.word_hashes(*words.text_bytes(pa.array([None, *texts]).slice(1)))
    assert h2.tolist() == h.tolist()
