"""Fill-in-middle against a plain version written here."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from strata.llm import middle

SPACES = "\t\n\x0b\x0c\r "


def kind(c):
    if c in SPACES:
        return "space"
    if c in "0123456789":
        return "digit"
    return "mark" if ord(c) < 128 and not c.isalnum() and ord(c) > 32 and c != "\x7f" else "letter"


ENDS = {
    "chars": lambda a, b: True,
    "words": lambda a, b: a in SPACES and b not in SPACES,
    "lines": lambda a, b: a == "\n",
    "sentences": lambda a, b: a in ".!?" and b in SPACES,
    "runs": lambda a, b: kind(a) != kind(b),
}


def brute_units(text, grammar):
    out = [text[0]] if text else []
    for a, b in zip(text, text[1:]):
        if ENDS[grammar](a, b):
            out.append("")
        out[-1] += b
    return out


def brute(doc_id, text, grammar="chars", seed=1):
    text = text or ""
    pieces = brute_units(text, grammar)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(pieces)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    pre, mid, suf = "".join(pieces[:a]), "".join(pieces[a:b]), "".join(pieces[b:])
    if h4 % 100 < 20:
        return n, "spm", pre, mid, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", pre, mid, f"<P>{pre}<S>{suf}<M>{mid}"


def texts():
    rng = random.Random(5)
    odd = [None, "", " ", "\n", "a", "\U0001f600", "\U0001f600\U0001f601\U00020000", "é‍\U0001f468‍\U0001f469", "has <P> inside", "<S>", "<M", "<", "<P<S<M", "x<", "<<<<<<", "S>P>M>", "same", "same", "l1\n\nl2\r\nl3\n", "end. Of! It?  Yes"]
    alphabet = "ab 1.\n<>PSM!\U0001f600é\x00퟿￿"
    return odd + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(200)]


@pytest.mark.parametrize("grammar", sorted(middle.GRAMMARS))
def test_equals_plain_version(spark, grammar):
    rows = [(i if i != 3 else None, t, "clash") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fim_form string")
    out = middle.fill_in_middle(docs, grammar=grammar).withColumn("back", middle.restore(F.col("fim_output"), F.col("fim_form"))).collect()
    assert len(out) == len(rows)
    for r in out:
        n, form, pre, mid, said = brute(r.doc_id, r.text, grammar)
        assert (r.fim_n, r.fim_form, r.fim_prefix, r.fim_middle, r.fim_output) == (n, form, pre, mid, said)
        assert r.back == (r.text or "")
    assert {r.fim_form for r in out} == {"plain", "psm", "spm"}


def test_units_lose_nothing(spark):
    docs = spark.createDataFrame([(t,) for t in texts()], "text string")
    for grammar in middle.GRAMMARS:
        for text, got in docs.select("text", middle.units(F.col("text"), grammar)).collect():
            assert got == brute_units(text or "", grammar)


def test_long_text_empty_table_and_own_columns(spark):
    long = "wörd \U0001f600 " * 100_000
    docs = spark.createDataFrame([(7, long, "kept", 1)], "doc_id long, text string, n string, `a.b` int")
    r = middle.fill_in_middle(docs).withColumn("back", middle.restore(F.col("fim_output"), F.col("fim_form"))).first()
    assert (r.fim_n, r.n, r["a.b"]) == (700_000, "kept", 1) and r.back == long
    assert middle.fill_in_middle(docs.limit(0)).count() == 0


def test_marks_that_could_be_misread():
    for wrong in [("", "b", "c"), ("aa", "b", "c"), ("<a", "a>", "m"), ("<P>", "<P>", "<M>"), ("xPx", "P", "<M>")]:
        with pytest.raises(ValueError):
            middle.Marks(*wrong)
    assert middle.Marks("||P", "||S", "||M").all() == ("||P", "||S", "||M")


def test_shares(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    forms = {r.fim_form: r["count"] for r in middle.fill_in_middle(docs).groupBy("fim_form").count().collect()}
    assert abs(forms["plain"] / 20_000 - 0.1) < 0.01 and abs(forms["spm"] / 20_000 - 0.18) < 0.01
