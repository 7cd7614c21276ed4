"""The pipeline stage by stage on a small table, and what it must not do to clean documents."""

import random
import re
import zlib

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def clean(rng, lang):
    vocabulary = {"en": "the of and with house river stone morning walked seldom under light window garden letter", "de": "der die und mit haus fluss stein morgen ging selten unter licht fenster garten brief"}[lang].split()
    made = [rng.choice(vocabulary) + rng.choice(["", "s", "en", "ing", "ly", "er"]) for _ in range(60)]
    return " ".join(made[:30]).capitalize() + ".\n" + " ".join(made[30:]).capitalize() + "."


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(0)
    texts = [(clean(rng, l), l) for l in ("en", "de") for _ in range(40)]
    base = texts[0][0]
    passage = " ".join(clean(rng, "en").split()[:25])
    planted = [base, base.replace("\n", " "), "1234 5678 9012 " * 5, None, "Home | About | Contact | Help\n" * 3 + "Too little.", texts[1][0] + "\nHome | About | Contact"]
    planted += [clean(rng, "en") + " " + passage, clean(rng, "en") + " " + passage]
    return [(i, t, l, "s", len(t)) for i, (t, l) in enumerate(texts)] + [(500 + i, t, "en", "s", len(t or "")) for i, t in enumerate(planted)] + [(0, base, "en", "s", len(base))]


def test_stages(spark, rows):
    from strata.llm import tokens

    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    steps = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    every = ids(docs)

    named = steps["language_id"](spark, docs, "")
    assert named.columns == docs.columns
    assert ids(named) == [i for i in every if i not in (502, 503)]

    good = steps["quality_rules"](spark, named, "")
    assert ids(good) == [i for i in ids(named) if i != 504]
    text = {r.doc_id: r for r in good.collect()}
    assert text[505].text == text[1].text and text[505].n_chars == len(text[505].text)
    assert all(text[r[0]].text == r[1] and text[r[0]].n_chars == r[4] for r in rows if r[0] < 500)

    single = steps["minhash_neardup"](spark, good, "")
    assert ids(single) == sorted(set(ids(good)) - {500, 501, 505})

    cut = steps["substring_dedup"](spark, single, "")
    assert cut.columns == docs.columns and ids(cut) == ids(single)
    left = {r.doc_id: r.text for r in cut.collect()}
    assert len(WORDS.findall(left[507])) == len(WORDS.findall(text[507].text)) - 25 and left[506] == text[506].text

    pieces = steps["bestfit_packing"](spark, cut, "").collect()
    t = tokens.tokenizer(tokens.public_path("byte_bpe_50k.json"))
    for p in pieces:
        ids_ = [*t.encode(left[p.doc_id], add_special_tokens=False).ids, 2]
        assert (p.length, p.ids_crc32) == (len(ids_), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids_)))
    assert sorted(p.doc_id for p in pieces) == ids(cut)


def test_languages_without_labels(spark):
    texts = ["Some words.", "1234 5678", None, "", "\u00e9t\u00e9", "\u6f22\u5b57", "-- 1 a"]
    docs = spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = dict(corpus_pipeline.STAGES)["language_id"](spark, docs, "")
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(i, texts[i]) for i in (0, 4, 5, 6)]


def test_one_id_with_several_texts(spark):
    """Of rows that share an id only those with similar texts are duplicates."""
    from strata.llm.neardup import near_duplicates

    rng = random.Random(5)
    a, b, c, d = ([f"{x}{rng.randrange(10**6)}" for _ in range(80)] for x in "abcd")
    said = [(3, a), (3, b), (8, [*a, "tail"]), (9, [*b, "tail"]), (10, c), (10, [*a[1:]]), (11, d), (11, [*d, "tail"]), (3, a)]
    rows = [(i, " ".join(w), "en", "s", len(" ".join(w))) for i, w in said] + [(12, None, "en", "s", 0), (12, "", "en", "s", 0), (12, rng.choice(c), "en", "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted((r.doc_id, r.nd_class) for r in near_duplicates(docs).collect())
    assert got == [(3, 3), (3, 3), (3, 3), (8, 3), (9, 3), (10, 3), (10, 10), (11, 11), (11, 11), (12, 12), (12, 12), (12, 12)]
    out = dict(corpus_pipeline.STAGES)["minhash_neardup"](spark, docs, "")
    left = [(r.doc_id, (r.text or "")[:1]) for r in out.collect()]
    assert out.columns == docs.columns and sorted(left) == [(3, "a"), (3, "b"), (10, "c"), (11, "d"), (12, ""), (12, ""), (12, "c")]


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "sequence_id", "offset"} <= set(out.columns) and out.count() > 50


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
