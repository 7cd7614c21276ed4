"""Licenses, quality rules and chat formatting against plain versions written here."""

import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strata.llm import chat, licenses, quality

TEXTS = [
    None, "", " \n\t ", "one", "a b c d e", "É x #1 *b* <c>\n\nÉ \U0001f600 | & $ %",
    "a b c d e a b c d e", "x " * 4000, "the same line\nthe same line\n\nthe same line\nother", "w1 w2 w3 w4 w5 w6 " * 3 + "tail",
    "MIT License, mit-license; KMIT LICENSE\nMIT  LICENSE", "GNU General Public License, version 3. Apache License, Version 2.0",
    "mit license" + " filler" * 50 + " Apache\nLicense mit license mit license", "general public licenses general publicé license",
    "Licensed under CC BY-NC 4.0. SPDX-License-Identifier: GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2 or later.",
]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    found = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if found[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_quality_counts(spark):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice(["a", "b", "c", " ", "\n", "#", "\x0b"]) for _ in range(rng.randrange(300))) for _ in range(40)]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    out = {r.doc_id: tuple(r[f"q_{x}"] for x in names) for r in quality.quality(docs(spark, texts)).collect()}
    assert out == {i: brute_quality(t) for i, t in enumerate(texts)}


def test_quality_lines(spark):
    clean = "Some plain prose that stands on a line, with a comma.\nAnd a second one that ends well, as it should.\nA third."
    texts = [clean, clean + "\nHome | About | Contact | Login", "Home | About | Contact | Login\n" * 4 + clean, clean + "\nAll rights reserved.", None]
    out = quality.quality(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r.q_kept for r in out] == [True, True, False, True, False]
    assert [r.q_clean_text for r in out] == [clean, clean, clean, clean, None]
    assert out[0].n_words == "clash"


def test_quality_of_repeated_rows_and_of_a_very_long_text(spark):
    rng = random.Random(11)
    long = " ".join(f"w{rng.randrange(10**6)}" + (".\n" if i % 12 == 11 else "") for i in range(250_000))
    rows = spark.createDataFrame([(1, long, "a"), (2, "same words " * 8, "b"), (2, "same words " * 8, "b"), (None, None, None)], "doc_id long, text string, q_kept string")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = [(r.doc_id, tuple(r[f"q_{x}"] for x in names)) for r in quality.quality(rows).collect()]
    assert sorted(got, key=repr) == sorted([(1, brute_quality(long)), *[(2, brute_quality("same words " * 8))] * 2, (None, brute_quality(None))], key=repr)


def test_a_very_long_conversation(spark):
    turns = [(5, i, ["user", "assistant"][i % 2], f"text {i} </turn> #") for i in range(4000)]
    out = chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").repartition(4)).withColumn("read", chat.read_turns(F.col("formatted"))).first()
    assert out.n_turns == 4000 and out.bad_turn is None and [(r.role, r.text) for r in out["read"]] == [(t[2], t[3]) for t in turns]


def brute_base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, name) for phrase, name in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def test_license_base(spark):
    out = licenses.scan(docs(spark, TEXTS)).collect()
    got = {r.doc_id: (r.lic_n_words, len(r.lic_base), min((x.start for x in r.lic_base), default=None), max((x.start for x in r.lic_base), default=None), r.lic_base_labels) for r in out}
    assert got == {i: brute_base(t) for i, t in enumerate(TEXTS)}
    assert all(set(r.lic_base_labels.split(",")) <= set(r.lic_labels.split(",")) for r in out if r.lic_base_labels)


def test_license_rules(spark):
    said = {
        "Released under the MIT License.": "mit", "under the Apache License, Version 2.0": "apache,apache-2.0", "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0",
        "GNU General Public License, version 2 or any later version": "gpl,gpl-2.0-or-later", "SPDX-License-Identifier: MPL-2.0": "mpl-2.0", "GNU Lesser General Public License v2.1": "gpl,lgpl-2.1",
        "the license plate": "", "CC BY-SA 3.0": "cc-by-sa-3.0", "permit licensees": "",
    }
    out = licenses.scan(docs(spark, list(said))).orderBy("doc_id").collect()
    assert [r.lic_labels for r in out] == list(said.values())
    assert len(licenses.build_rules()) > 200


def test_license_prefilter_lets_every_rule_through(spark):
    """Of every rule some text that it matches, in capitals: the prefilter must let it through."""
    rules = licenses.build_rules()
    said = [re.sub(r"\[([a-z])[a-z]*\]", r"\1", r.regex) for r in rules]
    for _ in range(4):
        said = [re.sub(r"\(\?:([^()|]*)[^()]*\)[?]?", r"\1", x) for x in said]
    said = [re.sub(r"\s+", " ", re.sub(r"\|.*| ?\?|\\|[()]", "", x)).upper() for x in said]
    df = spark.createDataFrame([(x,) for x in said], "t string").select("t", licenses.may_match(F.split(F.lower("t"), licenses.NOT_WORD)).alias("m"))
    assert [r.t for r in df.where("not m").collect()] == []


def spelled(pattern):
    """Every text that a rule's pattern says, a repeated part as seldom as it may be and once."""
    out = [""]
    for op, arg in pattern:
        name = str(op)
        if name == "LITERAL":
            more = [chr(arg)]
        elif name == "NOT_LITERAL":
            more = ["z"]
        elif name == "IN":
            more = [chr(a if str(kind) == "LITERAL" else a[0]) for kind, a in arg]
        elif name == "BRANCH":
            more = [x for branch in arg[1] for x in spelled(branch)]
        elif name == "SUBPATTERN":
            more = spelled(arg[3])
        elif name == "MAX_REPEAT":
            more = [x * n for n in sorted({arg[0], max(arg[0], 1)}) for x in spelled(arg[2])]
        else:
            raise ValueError(name)
        out = [a + b for a in out for b in dict.fromkeys(more)]
    return out


def test_license_keywords_follow_from_the_rules():
    """Of every rule every alternative: it must contain the rule's keyword and an anchor."""
    anchors, lost = set(licenses.ANCHORS), []
    for r in licenses.build_rules():
        for text in spelled(re._parser.parse(r.regex)):
            assert re.fullmatch(r.regex, text)
            words = re.findall("[a-z0-9]+", text)
            if r.keyword not in " ".join(words) or not anchors & set(words):
                lost.append((r.label, r.keyword, text))
    assert lost == []


def test_license_short_names(spark):
    said = {
        "licensed under the GPL v2": "gpl-2.0", "GNU GPL version 3": "gpl-3.0", "GPLv3": "gpl-3.0", "GPL-2.0": "gpl-2.0", "AGPL-3.0": "agpl-3.0", "the GNU AGPLv3": "agpl-3.0", "LGPL 2.1": "lgpl-2.1",
        "GPL v2 or later": "gpl-2.0-or-later", "GNU Library General Public License, version 2": "gpl,lgpl-2.0",
    }
    out = licenses.scan(docs(spark, list(said))).orderBy("doc_id").collect()
    assert [r.lic_labels for r in out] == list(said.values())
    assert all(r.lic_score >= 0.95 for r in out)


def brute_unsuppressed(found):
    return sorted(d for d in found if not any(e != d and e[0] <= d[0] and e[1] >= d[1] and (e[2] > d[2] or e[2] == d[2] and (e[:2] != d[:2] or e[3] < d[3])) for e in found))


def test_license_suppression(spark):
    rng = random.Random(3)
    cases = [[(s := rng.randrange(12), s + rng.randrange(1, 6), rng.randrange(3), k) for k in range(rng.randrange(9))] for _ in range(60)]
    cases += [[(s := rng.randrange(900), s + rng.randrange(1, 9), rng.randrange(3), k) for k in range(700)]]
    kind = "id long, ds array<struct<start:int,end:int,priority:int,ord:int,label:string,score:double>>"
    df = spark.createDataFrame([(i, [(*d, "x", 1.0) for d in c]) for i, c in enumerate(cases)], kind)
    for r in df.select("id", licenses.unsuppressed(F.col("ds"), (0, 1, 2)).alias("k")).collect():
        assert sorted((d.start, d.end, d.priority, d.ord) for d in r.k) == brute_unsuppressed(cases[r.id])


def brute_scan(text, rules):
    """Detections by trying every rule at every text, without keywords or anchors."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    padded, found = " " + " ".join(words) + " ", []
    for k, r in enumerate(rules):
        for m in re.finditer(f"(?<= )(?:{r.regex})(?= )", padded):
            start = padded.count(" ", 0, m.start()) - 1
            found.append((start, start + 1 + m[0].count(" "), r.priority, k))
    return [(rules[k].label, s, e, p) for s, e, p, k in brute_unsuppressed(found)]


def test_license_labels_equal_a_scan_by_all_rules(spark):
    rng, rules = random.Random(9), licenses.build_rules()
    said = [x for r in rules for x in spelled(re._parser.parse(r.regex))[:12]]
    filler = ["the", "plain", "license", "gnu", "v2", "2", "0", "or", "later", "only", "software", "é", "plate"]
    texts = said[::9] + [" ".join(rng.choice([rng.choice(said), rng.choice(filler)]) + rng.choice(["", ",", " -", "\n"]) for _ in range(rng.randrange(1, 14))).title() for _ in range(250)]
    out = licenses.scan(docs(spark, texts).repartition(4)).select("doc_id", "lic_detections").collect()
    for r in out:
        assert sorted((d.label, d.start, d.end, d.priority) for d in r.lic_detections) == sorted(brute_scan(texts[r.doc_id], rules)), texts[r.doc_id]


def test_license_rules_are_written_by_hand():
    assert len(licenses.NAMED) + len(licenses.SAID) + len(licenses.SENTENCES) + len(licenses.SINGLE) + len(licenses.VERSIONED) > 250


def test_license_scan_of_a_text_with_very_many_matches(spark):
    n = 20_000
    text = "MIT License. GPLv3, all rights reserved; " * n
    began = time.perf_counter()
    r = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    took = time.perf_counter() - began
    assert (r.lic_n_words, len(r.lic_base), len(r.lic_detections)) == (6 * n, n, 3 * n)
    assert (r.lic_base[-1].start, r.lic_detections[-1].start, r.lic_labels) == (6 * n - 6, 6 * n - 3, "all-rights-reserved,gpl-3.0,mit")
    assert took < 60


def test_license_rows_that_repeat(spark):
    out = licenses.scan(spark.createDataFrame([(1, "MIT license", "x"), (1, "MIT license", "x"), (None, "GPLv2", "y")], "doc_id long, text string, lic_labels string")).collect()
    assert sorted((r.doc_id or 0, r.lic_labels) for r in out) == [(0, "gpl-2.0"), (1, "mit"), (1, "mit")]


TEMPLATES = [
    chat.Template(),
    chat.Template(open="<|im_start|>", after_role="\n", close="<|im_end|>\n", escapes=(("\\", "\\b"), ("<", "\\l"), ("\n", "\\n"))),
    chat.Template(open="[", after_role="] ", close="$.*(end)$", escapes=(("%", "%p"), ("]", "%r"), ("$", "%d")), titles={"user": "U", "assistant": "A"}),
    chat.Template(open="", after_role="=", close=";", escapes=(("^", "^c"), ("=", "^q"), (";", "^s")), titles={}),
]


@pytest.mark.parametrize("template", TEMPLATES, ids=range(len(TEMPLATES)))
def test_chat_round_trip(spark, template):
    rng = random.Random(2)
    bits = [*"\\#<:=;^%$]|[>", "</turn>\n", "### User: ", "é", "\n", "a", "\\b", "\\e", " ", template.open, template.close, template.after_role, *[w for _, w in template.escapes]]
    roles = ["user", "assistant", "system", "User", "U", "A", "tool:\\e", "%e", "end|>", "im_end|>\n", "", None]
    rows = [(c, rng.choice([0, 1, 2, None]), rng.choice(roles), None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randrange(12)))) for c in range(60) for _ in range(rng.randrange(1, 6))]
    rows += [(5, 1, "user", "tie"), (5, 1, "user", "tie"), (7, 1, "user", "="), (7, 1, "user", "<"), (None, 0, "user", "no id")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_chats(df, template).withColumn("read", chat.read_turns(F.col("formatted"), template)).withColumn("learned", chat.learned_text(F.col("segments"), template)).collect()
    want = {}
    for c, t, r, x in sorted(rows, key=lambda z: (str(z[0]), -1 if z[1] is None else z[1], (z[2] or "").encode(), (z[3] or "").encode())):
        want.setdefault(c, []).append((r or "", x or ""))
    assert len(out) == len(want)
    for r in out:
        assert [(x.role, x.text) for x in r.read] == want[r.conv_id]
        assert r.learned == "".join(x.text for x in r.read if x.role == "assistant")
        assert r.formatted == "".join(s.text for s in r.segments)


@pytest.mark.parametrize(
    "wrong",
    [{"close": "end"}, {"after_role": " - "}, {"escapes": (("\\", "\\b"),)}, {"escapes": (("\\", "/b"), ("<", "\\l"), (":", "\\c"))}, {"titles": {"user": "U:"}}, {"titles": {"user": "X", "tool": "X"}}, {"open": "x<"}, {"escapes": (("\\", "\\e"), ("<", "\\l"), (":", "\\c"))}],
)
def test_templates_that_cannot_be_read_back_are_refused(wrong):
    with pytest.raises(ValueError, match="read back"):
        chat.Template(**wrong)


@pytest.mark.parametrize(("roles", "bad"), [("system user assistant", None), ("user assistant user assistant", None), ("assistant", 0), ("user user", 1), ("user", 1), ("user system", 1)])
def test_chat_machine(spark, roles, bad):
    rows = [(1, i, r, "x") for i, r in enumerate(roles.split())]
    assert chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first().bad_turn == bad


def test_chat_query_equals_sql(spark, tmp_path):
    import duckdb

    from strata.llm import queries

    rng = random.Random(4)
    rows = [(c, rng.choice([t, None]), rng.choice(["user", "assistant"] * 4 + ["system", "tool:", "User", "", None]), rng.choice(["x", None, "a:<#\\\\"])) for c in range(80) for t in range(rng.randrange(1, 5))]
    rows += [(100, t, "user" if t % 2 == 0 else "assistant", "x") for t in range(6)] + [(101, 0, "assistant", "x"), (102, 0, "user", "x"), (103, 0, "user", "="), (103, 0, "user", "<")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = queries.QUERIES["op10_chat_format"](spark, str(tmp_path))
    rel = con.execute(queries.SQL["op10_chat_format"])
    assert got.columns == [d[0] for d in rel.description]
    got = sorted((tuple(r) for r in got.collect()), key=repr)
    assert got == sorted(rel.fetchall(), key=repr)
    assert {r[0]: r[6] for r in got if r[0] in (-7, 100, 101, 102)} == {-7: None, 100: None, 101: 0, 102: 1}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert quality.quality(none).count() == licenses.scan(none).count() == 0
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0

