"""Search, packing and BPE against brute force and exact round trips."""

import math
import random
import sys
import zlib
from array import array

import numpy as np
import pytest

from strata.llm import bpe, packing, search, tokens

WORD, BYTE = tokens.public_path("word_bpe_49k.json"), tokens.public_path("byte_bpe_50k.json")


def brute_top(rows, asked, k, scale):
    ok = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and i is not None]
    least = {}
    for i, v in rows:
        if (i, v) and i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and asked(i):
            least[i] = min(least.get(i, v), v)
    out = []
    for q, raw in least.items():
        v = [math.floor(scale * x) for x in raw]
        cut = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
        found = sorted((-cut(sum(a * b for a, b in zip(v, w, strict=True))), i) for i, w in ok if i != q and len(w) == len(v))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("dim", [1, 5, 64])
@pytest.mark.parametrize(("block_bytes", "sample"), [(600, 5), (1 << 20, 200)])
def test_top_k(spark, dim, block_bytes, sample):
    rng = np.random.default_rng(dim)
    rows = [(i, rng.normal(0, 0.3, dim).round(1 if dim < 64 else 7).tolist()) for i in range(400)]
    rows += [(1000, None), (1001, []), (1020, []), (1030, []), (1002, [None] * dim), (1003, [float("nan")] * dim), (1004, [float("inf")] + [0.0] * (dim - 1)), (None, [0.1] * dim), (1006, [0.5] * (dim + 1)), (1007, rows[3][1]), (1010, [0.0] * dim)]
    rows += [(20, [0.25] * dim), (20, None), (30, rows[30][1]), (41, [1.5] * dim), (41, [1.5] * dim)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string").repartition(3)
    got = search.top_k(df, df.where("vec_id % 10 = 0"), k=7, block_bytes=block_bytes if dim < 64 else 20 * block_bytes, sample=sample).collect()
    assert sorted(tuple(r) for r in got) == brute_top(rows, lambda i: i % 10 == 0, 7, 1024)


def test_top_k_of_copies(spark):
    """A third of the rows are one vector: ties beyond k go to the smaller ids."""
    rng = np.random.default_rng(1)
    rows = [(i, [0.5] * 8 if i % 3 == 0 else rng.normal(0, 0.3, 8).round(2).tolist()) for i in range(2400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    got = search.top_k(df, df.where("vec_id % 100 = 0"), k=10, sample=64).collect()
    assert sorted(tuple(r) for r in got) == brute_top(rows, lambda i: i % 100 == 0, 10, 1024)


def test_a_bar_is_a_score_that_the_table_has():
    rng = np.random.default_rng(2)
    x = np.floor(1024 * rng.normal(0, 1, (500, 16)))
    best = search.Best(np.arange(20), x[:20], 5)
    best.bar(np.arange(100, 200), x[100:200])
    want = np.sort(x[:20] @ x.T - np.eye(20, 500) * 1e12, axis=1)[:, -5]
    assert (best.least <= want).all() and np.isfinite(best.least).all()


def test_top_k_of_large_numbers(spark):
    rows = [(i, [s * 10.0**e, 1.0]) for i, (s, e) in enumerate([(1, 3), (1, 9), (-1, 9), (1, 5), (-1, 2)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in search.top_k(df, df, k=3).collect()) == brute_top(rows, lambda i: True, 3, 1024)


def test_top_k_of_none(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert search.top_k(none, none).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(0)
    a, b = np.floor(1024 * rng.normal(0, 1, (20, 37))), np.floor(1024 * rng.normal(0, 1, (30, 37)))
    last = None
    for starts in search.levels(37):
        bound = search.statistics(a, starts) @ search.statistics(b, starts).T
        assert (bound >= a @ b.T - 1e-3).all()
        if last is None or set(last[0]) <= set(starts):  # a level that cuts the last one's segments is tighter
            assert last is None or (bound <= last[1] + 1e-3).all()
        last = starts, bound


@pytest.mark.parametrize("kind", ["clusters", "no structure"])
def test_few_pairs_survive_the_levels(kind):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (6000, 64))
    if kind == "clusters":
        x = 4 * rng.normal(0, 1, (40, 64))[rng.integers(0, 40, 6000)] + x
    x = np.floor(1024 * x / np.linalg.norm(x, axis=1, keepdims=True))
    ids, turn = np.arange(6000), search.axes(x[:2000])
    starts, _ = search.useful(x[::100], x[:2000], turn, 10)
    best = search.Best(ids[::100], x[::100], 10, turn, starts)
    best.bar(ids[:2000], x[:2000])
    for a in range(0, 6000, 1024):
        best.add(ids[a : a + 1024], x[a : a + 1024])
    assert best.pairs == 60 * 6000 and sorted(best.left, reverse=True) == best.left and best.left[-1] < 0.1 * best.pairs
    if kind == "clusters":
        assert len(starts[0]) <= 16 and best.left[0] < 0.5 * best.pairs  # coarse levels do their part
    score = np.where(ids[::100, None] == ids[None, :], -np.inf, x[::100] @ x.T)
    for q in range(60):
        want = sorted(zip(-score[q], ids, strict=True))[:10]
        mine = best.query == q
        assert list(zip(-best.score[mine], best.id[mine], strict=True)) == want


TEXTS = [
    None, "", " ", "one", "Two words", "It's THE dogs' don't; we'll 123 4² <|endoftext|> <|startoftext|>x", "é É İΣς Å　中文 \U0001f600‍", "a" * 5000, "\t\n\r \x0b\x0c x\x1c\x85 y",
    "!!! ??? ... --- <|endoftext", "word " * 3000, " ́x ̧y", "\x00\x01\x7f ﻿ z",
]


def many(seed=7, n=60):
    rng = random.Random(seed)
    alphabet = [*"abcXYZ'019 .,\n\t  ", "é", "ß", "é", "中", "\U0001f600", " ", "<|endoftext|>", "the ", "'s"]
    shared = "".join(rng.choice(alphabet) for _ in range(3000))
    out = []
    for _ in range(n):
        a = rng.randrange(2500)
        out.append("".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) + shared[a : a + rng.randrange(3000)] + "".join(rng.choice(alphabet) for _ in range(rng.randrange(50))))
    return TEXTS + out


def plain(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def cores_of(texts, bits):
    cut = [bpe.segments(np.frombuffer(t, np.uint8), bits) for t in texts]
    return cut, [t[a:b] for t, parts in zip(texts, cut, strict=True) for a, b, core in parts if core]


@pytest.mark.parametrize(("bits", "how"), [(4, {}), (9, {}), (6, {"bundle_bytes": 3000}), (6, {"bundle_bytes": 3000, "ward_bytes": 1 << 14})])
def test_chunks_give_the_ids_of_the_whole(spark, bits, how):
    texts, t = many() * 2, plain(WORD)
    df = spark.createDataFrame([(i, x, "c", "d", b"e") for i, x in enumerate(texts)], "doc_id long, text string, bpe_ids string, c0 string, bpe_rows binary").repartition(3)
    out = bpe.encode_decode(df, WORD, chunk_bits=bits, outputs=("bpe_ids", "bpe_decoded", "bpe_new_chunks"), **how)
    assert out.columns == ["doc_id", "text", "c0", "bpe_rows", "bpe_n_tokens", "bpe_ids", "bpe_decoded", "bpe_new_chunks"]
    out = out.collect()
    assert sorted(r.doc_id for r in out) == list(range(len(texts)))
    for r in out:
        ids = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.bpe_ids == ids and r.bpe_n_tokens == len(ids) and (r.text, r.c0) == (texts[r.doc_id], "d")
        assert r.bpe_decoded == t.decode(ids, skip_special_tokens=False)
    _, cores = cores_of([(x or "").encode() for x in texts], bits)
    new = sum(r.bpe_new_chunks for r in out)
    # Once for the table; with several wards once for each.
    assert new == len(set(cores)) < len(cores) if "ward_bytes" not in how else len(set(cores)) <= new < len(cores)


def test_chunks_of_repeated_rows_and_empty_tables(spark):
    none = bpe.encode_decode(spark.createDataFrame([], "doc_id long, text string"), WORD)
    assert none.columns == ["doc_id", "text", "bpe_n_tokens", "bpe_ids", "bpe_decoded"] and none.count() == 0
    long = "stone house " * 40_000
    rows = [(1, long), (1, long), (1, long), (None, long), (2, None), (3, "")]
    out = bpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), WORD, bundle_bytes=1000, outputs=("bpe_ids_sha256", "bpe_new_chunks")).collect()
    assert {(r.doc_id, r.bpe_n_tokens) for r in out} == {(1, 80_000), (None, 80_000), (2, 0), (3, 0)} and len(out) == 6
    assert len({r.bpe_ids_sha256 for r in out}) == 2 and sum(r.bpe_new_chunks > 0 for r in out) <= 4


def test_chunks_are_reused_and_joins_repaired():
    c, cores = bpe.Codec(WORD, 6), {}
    texts = [x.encode() for x in many(n=30)[len(TEXTS) :]]
    c.encode(texts, cores_of(texts, 6)[0], cores)
    assert c.reused and c.repaired
    before, again = c.encoded, [b"another start " + x for x in texts]
    c.encode(again, cores_of(again, 6)[0], cores)
    assert c.encoded - before < before / 3


def test_segments_share_no_word():
    for t in many(n=20)[1:]:
        raw = t.encode()
        parts = bpe.segments(np.frombuffer(raw, np.uint8), 5)
        assert b"".join(raw[a:b] for a, b, _ in parts) == raw
        assert all(raw[a : a + 1] in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r") for a, _, _ in parts[1:])


def test_fast_encoder_agrees_on_every_character():
    encode, t = tokens.encoder(BYTE), plain(BYTE)
    chars = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    step = 2000
    for a in range(0, len(chars), step):
        text = "".join(f"a{c}b {c}1  {c}\n" for c in chars[a : a + step])
        assert encode(text).tolist() == t.encode(text, add_special_tokens=False).ids, hex(ord(chars[a]))
    for x in many():
        assert encode(x or "").tolist() == t.encode(x or "", add_special_tokens=False).ids


def test_packing(spark):
    texts, t = many(n=200) * 3, plain(BYTE)
    df = spark.createDataFrame([(i if i % 50 else None, x, "c") for i, x in enumerate(texts)], "doc_id long, text string, offset string").repartition(9)
    rows = packing.pack(df, BYTE, length=256, fan=2, task_pieces=64, promoted=8, keep_ids=True).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    total = 0
    for i, x in enumerate(texts):
        ids = array("I", [*t.encode(x or "", add_special_tokens=False).ids, 2])
        total += len(ids)
        if i % 50 == 0:
            continue
        ps = sorted(by_doc[i], key=lambda r: r.piece)
        assert [p.piece for p in ps] == list(range(len(ps)))
        assert b"".join(p.ids for p in ps) == ids.tobytes()
        assert all(zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length for p in ps)
        assert [p.start for p in ps] == [sum(q.length for q in ps[:k]) for k in range(len(ps))]
        assert len(ps) == -(-len(ids) // 256)
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert len(by_seq) <= 1.03 * -(-total // 256)


def test_packing_of_none(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), BYTE).count() == 0
    assert [tuple(r)[1:5] for r in packing.pack(spark.createDataFrame([(1, None)], "doc_id long, text string"), BYTE).collect()] == [(0, 0, 1, zlib.crc32(b"\2\0\0\0"))]


def test_best_fit_is_tight():
    rng = random.Random(0)
    bins = [(rng.randrange(1, 101), [k]) for k in range(500)]
    out = packing.best_fit(bins, 100)
    size = dict(zip(range(500), (u for u, _ in bins), strict=True))
    assert sorted(i for _, items in out for i in items) == list(range(500))
    assert all(u == sum(size[i] for i in items) <= 100 for u, items in out)
    assert len(out) <= 1.05 * sum(u for u, _ in bins) / 100


@pytest.mark.parametrize(("order", "task_pieces", "most"), [("as given", 1 << 17, 1.0), ("as given", 500, 1.03), ("shuffled", 500, 1.03)])
def test_packing_does_not_follow_the_order_of_the_input(spark, order, task_pieces, most):
    """Two partitions of texts of one length each, of which one and one fill a sequence. Tasks of 500
    have by chance a few more of one than of the other."""
    rows = [(i, "house " * (700 if i < 1500 else 300)) for i in range(3000)]
    if order == "shuffled":
        random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    docs = docs.where("doc_id < 1500").unionByName(docs.where("doc_id >= 1500")) if order == "as given" else docs
    out = packing.pack(docs, BYTE, task_pieces=task_pieces).collect()
    assert len(out) == 3000 and len({r.sequence_id for r in out}) <= most * 1500


def test_packing_of_repeated_rows_and_very_long_texts(spark):
    docs = spark.createDataFrame([(7, "house " * 300)] * 400 + [(8, "stone " * 200_000), (9, "")], "doc_id long, text string")
    out = packing.pack(docs, BYTE, task_pieces=50).collect()
    assert sum(r.length for r in out if r.doc_id == 8) == 200_002 and sum(r.doc_id == 7 for r in out) == 400
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in x) <= 1024 and sorted(o for o, _ in x) == [sum(n for _, n in sorted(x)[:k]) for k in range(len(x))] for x in by.values())
    assert len(by) <= 1.02 * sum(r.length for r in out) / 903  # three texts of 301 fill a sequence to 903


def test_handing_on_the_emptiest_bins_gives_up_no_join():
    """Groups packed alone, then merged: with all bins handed on or the emptiest few, as many bins come out."""
    rng = random.Random(3)
    for _ in range(60):
        groups = [[(rng.randrange(1, 101), [0]) for _ in range(rng.randrange(1, 60))] for _ in range(4)]
        packed = [packing.best_fit(g, 100) for g in groups]
        every = packing.best_fit([b for g in packed for b in g], 100)
        few = [sorted(g, key=lambda b: b[0]) for g in packed]
        some = packing.best_fit([b for g in few for b in g[:8]], 100)
        assert len(every) == len(some) + sum(len(g[8:]) for g in few)
