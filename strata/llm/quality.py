"""Quality rules, line first: judge lines, remove those that fail, then judge what is left.

Everything is a built-in expression over one row, so the operator is a single scan without a
shuffle and its cost follows the bytes of text, whatever the skew of any key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.columns import SPACE, WORD_CHAR, let, matches, once, words_of

SYMBOLS = r"[#*$%&|<>]"

#: Phrases of site furniture; a short line that holds one is boilerplate.
BOILERPLATE = (
    "accept all cookies", "accept cookies", "all rights reserved", "back to top", "click here to",
    "cookie policy", "cookie settings", "enable javascript", "follow us on", "javascript is disabled",
    "log in to", "lorem ipsum", "powered by", "privacy policy", "read more", "share this", "sign in to",
    "sign up for", "skip to content", "subscribe to our", "terms of service", "terms of use",
    "use of cookies", "view all posts",
)


def line_fails(
    line: Column,
    *,
    symbol_share: float = 0.1,
    shout_share: float = 0.3,
    bar_share: float = 0.25,
    boilerplate_words: int = 12,
    repeat_words: int = 10,
) -> Column:
    """True where a line breaks a punctuation, navigation or boilerplate rule.

    Punctuation: symbols make up `symbol_share` of the characters, or runs of exclamation or
    question marks end `shout_share` of the words. Navigation: `|`, `»`, `›` or `•` stand alone as
    at least 2 and as `bar_share` of the words. Boilerplate: a line of at most
    `boilerplate_words` words holds a phrase of BOILERPLATE, or one word makes up a line of at
    least `repeat_words`. A blank line never fails.
    """
    symbols = matches(line, SYMBOLS)
    shouts = matches(line, rf"[!?]{{2,}}(?={SPACE}|$)")
    bars = matches(line, rf"[|»›•](?<!{WORD_CHAR}.)(?!{WORD_CHAR})")
    phrase = "|".join(x.replace(" ", " +") for x in BOILERPLATE)

    def broken(words: Column) -> Column:
        n = F.size(words)
        return (n > 0) & (
            let(symbols, lambda k: (k >= 3) & (k >= symbol_share * F.length(line)))
            | let(shouts, lambda k: (k >= 2) & (k >= shout_share * n))
            | let(bars, lambda k: (k >= 2) & (k >= bar_share * n))
            | ((n <= boilerplate_words) & F.lower(line).rlike(phrase))
            | ((n >= repeat_words) & (F.size(F.array_distinct(words)) == 1))
        )

    return let(words_of(line), broken)


def words_in_repeated_windows(words: Column, width: int = 5) -> Column:
    """Words that windows of `width` words cover whose sequence is found twice or more in `words`.

    Windows are compared by 64-bit hashes of their words, once per row: sorted hashes show equal
    neighbours, and the covered words are the union of [p, p + width) over their places. Rows
    without an equal pair stop after a distinct.
    """
    places = F.sequence(F.lit(0), F.size(words) - F.lit(width))

    def covered(hashes: Column) -> Column:
        marked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        equal = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
        repeated = let(
            marked,
            lambda m: F.transform(
                F.filter(m, lambda e, i: equal(e, F.get(m, i - 1)) | equal(e, F.get(m, i + 1))),
                lambda e: e["p"],
            ),
        )
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            F.sort_array(repeated),
            start,
            lambda acc, p: F.struct(
                (acc["n"] + p + F.lit(width) - F.greatest(p, acc["end"])).alias("n"), (p + F.lit(width)).alias("end")
            ),
            lambda acc: acc["n"],
        )

    hashes = F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) > width, found).otherwise(F.lit(0))


def quality(
    docs: DataFrame,
    *,
    min_words: int = 10,
    max_repeat_percent: int = 20,
    max_lost: float = 0.3,
    text: str = "text",
    prefix: str = "q_",
) -> DataFrame:
    """docs plus `q_` columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, lost (share of the characters in words that failing lines held), clean_text and kept.

    A null text counts as empty. A text without words has fewer than min_words and isn't kept.
    clean_text is the text without the failing lines, unchanged if none fails; null stays null.
    Every row is judged by its own text, so repeated rows get equal verdicts; a text that loses exactly
    max_lost is kept. A very long text is one row: its words and windows are arrays in one task. An empty
    table gives no rows. Input columns stay, but for those whose names begin with the prefix.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    spaces = F.lit(f"{SPACE}+")
    judged = F.transform(F.split(t, "\n"), lambda x: F.struct(x.alias("line"), line_fails(x).alias("fails")))

    def cleaned(lines: Column) -> Column:
        kept = F.array_join(F.transform(F.filter(lines, lambda x: ~x["fails"]), lambda x: x["line"]), "\n")
        return F.when(F.exists(lines, lambda x: x["fails"]), kept)

    def counts(words: Column, clean: Column) -> Column:
        with_word = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD_CHAR))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            matches(t, SYMBOLS).cast("long").alias("n_symbols"),
            let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            words_in_repeated_windows(words).cast("long").alias("n_repeat_words"),
            F.length(F.regexp_replace(clean, spaces, F.lit(""))).alias("left"),
            clean.alias("clean"),
        )

    found = let(words_of(t), lambda w: let(let(judged, cleaned), lambda c: counts(w, c)))
    rows = once(docs.drop(*[c for c in docs.columns if c.startswith(prefix)]), found, f"{prefix}found")
    q = F.col(f"{prefix}found")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    base = (q["n_words"] < min_words) | (F.lit(100) * q["n_repeat_words"] > F.lit(max_repeat_percent) * q["n_words"])
    lost = F.when(q["left"].isNotNull() & (q["word_chars"] > 0), F.lit(1.0) - q["left"] / q["word_chars"]).otherwise(F.lit(0.0))
    made = {n: q[n] for n in names} | {"clean_text": F.coalesce(q["clean"], F.col(text)), "base_failed": base, "lost": lost, "kept": ~base & (lost <= max_lost)}
    return rows.withColumns({f"{prefix}{n}": c for n, c in made.items()}).drop(f"{prefix}found")
