"""Fill-in-middle: texts cut into units at lookaround boundaries, two cuts, and the middle moved last.

A unit grammar names classes of neighbouring characters; it becomes one zero-width pattern that
matches between two characters of such classes and nowhere else. Splitting at it therefore loses
no character: the units joined again are the text. Everything is an expression over one row, so
there is no shuffle, and a lost task is simply run again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.chat import literal
from strata.llm.columns import SPACE, WORD_CHAR, let

ANY = r"[\x{0}-\x{10FFFF}]"
_DIGIT, _MARK = r"[0-9]", r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"
_LETTER = r"[^\x09-\x0D\x20-\x40\x5B-\x60\x7B-\x7E]"
_RUNS = (SPACE, _DIGIT, _MARK, _LETTER)

#: Unit grammars: the pairs (class of the character before, class of the character after) between
#: which a unit ends. Classes tell single characters apart and hold either all characters beyond
#: U+FFFF or none, so half of a surrogate pair never counts as a neighbour of its own.
GRAMMARS: dict[str, tuple[tuple[str, str], ...]] = {
    "chars": ((ANY, ANY),),
    "words": ((SPACE, WORD_CHAR),),  # a word and the space after it
    "lines": ((r"\n", ANY),),
    "sentences": ((r"[.!?]", SPACE),),
    "runs": tuple((a, b) for a in _RUNS for b in _RUNS if a != b),
}


def boundary(grammar: str) -> str:
    """The zero-width pattern of a unit grammar."""
    return "|".join(f"(?<={before})(?={after})" for before, after in GRAMMARS[grammar])


def units(text: Column, grammar: str = "chars") -> Column:
    """The units of a text in order; none of an empty or null one, which a split would make one empty unit."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


@dataclass(frozen=True)
class Marks:
    """What stands before the three parts. No mark may end as one begins (itself included), or a
    part's last characters and the mark after it could be read as a mark that starts earlier."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        if not all(marks) or len(set(marks)) < 3:
            raise ValueError("marks must be three different texts")
        if any(b.startswith(a[i:]) for a in marks for b in marks for i in range(a == b, len(a))) or any(a != b and a in b for a in marks for b in marks):
            raise ValueError("marks overlap, so what they separate couldn't be read back")

    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 from the SHA-256 of the seed and a key (null: empty)."""
    hexes = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hexes, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, *, grammar: str = "chars", seed: int = 1, share: int = 90, spm_share: int = 20, marks: Marks | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs plus fim_n (units), fim_form (plain, psm or spm), fim_prefix, fim_middle, fim_suffix (null
    if plain) and fim_output.

    Where a text is cut, whether it is cut at all (`share` of 100) and the order of its parts
    (`spm_share` of 100 put the suffix first) depend on the id and the seed alone, so repeated rows and
    rows with equal ids and texts get equal results. A null text counts as empty and a null id as an
    empty one. Empty texts and texts that hold a mark stay as they are. A very long text is an array
    of its units in one row. An empty table gives no rows. Columns of docs stay; one with a name of
    the result's is overwritten.
    """
    marks = marks or Marks()
    made = ("fim_n", "fim_form", "fim_prefix", "fim_middle", "fim_suffix", "fim_output")
    rows = docs.drop(*[c for c in made if c not in (doc_id, text)])
    plain_text = F.coalesce(F.col(text), F.lit(""))
    h1, h2, h3, h4 = draws(F.col(doc_id), seed)
    held = F.lit(False)
    for m in marks.all():
        held = held | plain_text.contains(m)
    form = F.when((plain_text == "") | held | (h3 % 100 >= share), "plain").when(h4 % 100 < spm_share, "spm").otherwise("psm")

    def cut(p: Column) -> Column:
        n = F.size(p).cast("long")
        one, two = h1 % (n + 1), h2 % (n + 1)
        return let(F.struct(n.alias("n"), F.least(one, two).cast("int").alias("a"), F.greatest(one, two).cast("int").alias("b")), lambda c: F.struct(
            c["n"].alias("n"),
            F.array_join(F.slice(p, F.lit(1), c["a"]), "").alias("prefix"),
            F.array_join(F.slice(p, c["a"] + 1, c["b"] - c["a"]), "").alias("middle"),
            F.array_join(F.slice(p, c["b"] + 1, F.size(p) - c["b"]), "").alias("suffix"),
        ))

    cuts = let(units(plain_text, grammar), cut)
    parts = rows.withColumns({"fim_form": form, "fim_cut": cuts})
    moved = F.col("fim_form") != "plain"
    first, last = F.concat(F.lit(marks.prefix), "fim_prefix"), F.concat(F.lit(marks.suffix), "fim_suffix")
    output = F.concat(F.when(F.col("fim_form") == "spm", F.concat(last, first)).otherwise(F.concat(first, last)), F.lit(marks.middle), F.col("fim_middle"))
    out = parts.select(
        *[F.col(f"`{c}`") for c in rows.columns], F.col("fim_cut.n").alias("fim_n"), "fim_form", *[F.when(moved, F.col(f"fim_cut.{x}")).alias(f"fim_{x}") for x in ("prefix", "middle", "suffix")]
    )
    return out.withColumn("fim_output", F.when(moved, output).otherwise(plain_text))


def restore(output: Column, form: Column, marks: Marks | None = None) -> Column:
    """The text that was cut, from what fill_in_middle wrote with the same marks and the form that it chose."""
    marks = marks or Marks()

    def read(first: str, second: str) -> Column:
        parts = F.split(F.substring(output, len(first) + 1, 1 << 30), f"{literal(second)}|{literal(marks.middle)}", -1)
        return let(parts, lambda p: F.concat(F.get(p, F.lit(0 if first == marks.prefix else 1)), F.get(p, F.lit(2)), F.get(p, F.lit(1 if first == marks.prefix else 0))))

    return F.when(form == "psm", read(marks.prefix, marks.suffix)).when(form == "spm", read(marks.suffix, marks.prefix)).otherwise(output)
