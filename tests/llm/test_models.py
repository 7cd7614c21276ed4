"""The trained operators by held-out accuracy, and the rows that models don't see."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import language, toxicity

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = language.identify(docs).withColumn("held", language.held_out("doc_id"))
    n, right = out.where("held").agg(F.count("*"), F.count_if(F.col("lang") == F.col("li_lang"))).first()
    assert n > 300 and right >= 0.97 * n
    assert out.where("li_score < 0 or li_score > 1 or li_score is null").count() == 0
    blind = language.identify(docs.withColumns({"lang": F.lit("zz"), "source": F.lit(None)}), labelled=docs)
    a, b = (dict(x.select("doc_id", "li_lang").collect()) for x in (out, blind))
    assert a == b


def test_language_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "12 34 !?"), (4, "é"), (5, "the " * 50000), (6, "中文")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, li_lang string")
    learned = spark.createDataFrame([(i, "the of and", "en") for i in range(40)] + [(100 + i, "der und die", "de") for i in range(40)], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in language.identify(docs, labelled=learned).collect()}
    assert [out[i].li_lang == "und" for i in range(1, 7)] == [True, True, True, False, False, False]
    assert out[5].li_lang == "en" and out[1].li_score == 0
    none = learned.where("false")
    assert {r.li_lang for r in language.identify(docs, labelled=none).collect()} == {"und"}
    assert language.identify(none).count() == 0


def test_windows_cover_whole_texts():
    import pyarrow as pa

    from strata.llm import words as W

    texts = ["a" * 10, "", "b" * 4, "c" * 9]
    w, owner, used = language.cut_windows(*W.text_bytes(pa.array(texts)), 4)
    assert owner.tolist() == [0, 0, 0, 2, 3, 3, 3] and used.tolist() == [4, 4, 2, 4, 4, 4, 1]
    assert b"".join(x[:u].tobytes() for x, u in zip(w, used, strict=True)) == b"".join(t.encode() for t in texts)


def test_pooled_tables_equal_filters():
    rng = np.random.default_rng(0)
    filters = [rng.normal(size=(k, 256, 3)).astype(np.float32) for k in language.WIDTHS]
    net = language.Network(["a", "b"], filters, rng.normal(size=(9, 2)), np.zeros(2), 20)
    x = rng.integers(0, 256, (5, 20)).astype(np.uint8)
    pooled = [max(sum(f[j, x[i, t + j], k] for j in range(len(f))) for t in range(20 - len(f) + 1)) for i in range(5) for f in filters for k in range(3)]
    z = np.maximum(np.array(pooled).reshape(5, 9), 0) @ net.weights
    want = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    assert np.allclose(net.probabilities(x), want, atol=1e-4)


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.toxicity(docs.select("doc_id", "text"), labels).join(labels, "doc_id").withColumn("held", language.held_out("doc_id")).where("held").toPandas()
    y, p = out.toxic.to_numpy() == 1, out.tox_score.to_numpy() >= 0.7
    assert len(out) > 1000 and (p & y).sum() >= 0.85 * y.sum() and (p & ~y).sum() <= 0.02 * (~y).sum()


@pytest.mark.parametrize(("sf", "least", "most"), [("sf0.001", 2, 0), ("sf0.01", 13, 0)])
def test_toxicity_from_few_labels(spark, sf, least, most):
    """6 and 33 toxic texts to learn from, 5 and 18 held out, some in languages of which one or two are known."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.toxicity(docs.select("doc_id", "text"), labels).join(labels, "doc_id").where(language.held_out("doc_id")).toPandas()
    y, p = out.toxic.to_numpy() == 1, out.tox_score.to_numpy() >= 0.7
    assert (p & y).sum() >= least and (p & ~y).sum() <= most


def test_toxicity_of_fewer_than_three_and_of_repeated_rows(spark):
    rows = [(i % 40, f"nice text {i % 40} " + ("awfulword " if i % 20 == 0 else "")) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    once = spark.createDataFrame(rows[:40], "doc_id long, text string")
    out = toxicity.toxicity(once, spark.createDataFrame([(0, 1), (20, 1), (1, 0)], "doc_id long, toxic int")).collect()
    assert len(out) == 40 and {r.tox_score for r in out} == {0.0}
    many = toxicity.toxicity(docs, spark.createDataFrame([(i, int(i % 20 == 0)) for i in range(40)], "doc_id long, toxic int")).collect()
    assert len(many) == 80 and all(len({r.tox_score for r in many if r.doc_id == i}) == 1 for i in range(40))


def test_scores_are_the_model_over_the_grams_of_each_text():
    import pyarrow as pa

    from strata.llm import words as W

    texts = ["Some, words here.", "", None, "other words", "Some"]
    value, _ = toxicity.grams(*W.text_bytes(pa.array(["some words"])))
    chosen = np.unique(value)[::2]
    model = toxicity.Model(chosen, np.linspace(-1, 1, len(chosen)), 0.25)
    got = model.scores(*W.text_bytes(pa.array(texts)))
    for t, g in zip(texts, got, strict=True):
        own = set(toxicity.grams(*W.text_bytes(pa.array([t], pa.string())))[0].tolist())
        z = 0.25 + sum(w for c, w in zip(chosen.tolist(), model.weights, strict=True) if c in own)
        assert abs(g - 1 / (1 + np.exp(-z))) < 1e-12


def test_toxicity_of_odd_rows(spark):
    rows = [(i, ("nice text here " + ("awfulword " if i % 3 == 0 else "")) * 3) for i in range(90)] + [(1000, None), (1001, ""), (None, "awfulword")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, tox_score string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(5, None), (None, 1), (7777, 1)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.tox_score <= 1 for r in out)
    assert min(r.tox_score for r in out if "awfulword" in (r.text or "")) > max(r.tox_score for r in out if "awfulword" not in (r.text or ""))
    assert {r.tox_score for r in toxicity.toxicity(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0


def test_risk_is_not_negative():
    # A single gram that only positives have: the unlabelled part holds as many as the prior says.
    positive = np.r_[np.ones(100, bool), np.zeros(1000, bool)]
    text = np.r_[np.arange(100), 100 + np.arange(100)]
    w, b = toxicity.fit(text, np.zeros(200, np.int64), positive, 1, 0.1)
    assert 1 / (1 + np.exp(-(w[0] + b))) > 0.9 and 1 / (1 + np.exp(-b)) < 0.1


@pytest.mark.parametrize("text", ["", "x", "Some, WORDS.", "é" * 9])
def test_grams(text):
    import pyarrow as pa

    from strata.llm import words as W

    value, _ = toxicity.grams(*W.text_bytes(pa.array(["pad", text])))
    raw = "".join(c if c.isalnum() else " " for c in text.lower())
    raw = (" " + " ".join(raw.split()) + " ").encode() if raw.strip() else b" "
    want = [int.from_bytes(raw[i : i + n], "little") | ((0xF0 + n) << 56 if n < 8 else 0) for n in toxicity.GRAMS for i in range(len(raw) - n + 1)]
    assert toxicity.grams(*W.text_bytes(pa.array([text])))[0].tolist() == want
    assert set(want) <= set(value.tolist())
