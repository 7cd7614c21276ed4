"""Markdown as rows of lines: prose, sentences, tables, alternations, specs and fenced regions.

A document is split into lines inside its own row and folded there with higher-order functions,
so no line ever needs a shuffle to know its fence or its section.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FENCE = r"^\s*(```|~~~)"
_LIST = r"^([-*+]|[0-9]+\.)\s+"


def _numbered(lines: Column) -> Column:
    """array<struct<line, said, fenced>>: numbered lines and whether each is in a fence or one. The work
    follows the lines and, for each, the fences of its text."""
    at = F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), x.alias("said"), x.rlike(FENCE).alias("fence")))
    both = F.array(F.struct(at.alias("at"), F.transform(F.filter(at, lambda x: x["fence"]), lambda x: x["line"]).alias("fences")))

    def marked(b: Column) -> Column:
        inside = lambda x: F.size(F.filter(b["fences"], lambda f: f <= x["line"])) % 2 == 1
        return F.transform(b["at"], lambda x: F.struct(x["line"].alias("line"), x["said"].alias("said"), (x["fence"] | inside(x)).alias("fenced")))

    return F.get(F.transform(both, marked), F.lit(0))


def prose_lines(docs: DataFrame) -> DataFrame:
    """(file, line, said) of docs(file, text): lines outside fences that aren't blank, a heading or a
    table row, without their list marker."""
    rows = docs.select("file", F.explode(_numbered(F.split("text", "\n"))).alias("x")).select("file", "x.*")
    said = F.trim("said")
    kept = rows.where(~F.col("fenced") & ~F.col("said").rlike(r"^\s*(#|\|)") & (said != ""))
    return kept.select("file", "line", F.regexp_replace(said, _LIST, "").alias("said"))


def sentences(paragraph: Column) -> Column:
    """Split after . ! or ? before white space and a capital, a digit or an opening mark."""
    return F.split(paragraph, r"(?<=[.!?])\s+(?=[A-Z0-9\"'(`\[*_])")


def units(docs: DataFrame) -> DataFrame:
    """(file, line, text): sentences of paragraphs, with the first line of the paragraph. Lines that
    follow one another without a gap are a paragraph: their number less their place is the same."""
    place = F.row_number().over(Window.partitionBy("file").orderBy("line"))
    rows = prose_lines(docs).withColumn("island", F.col("line") - place).groupBy("file", "island").agg(F.sort_array(F.collect_list(F.struct("line", "said"))).alias("ls"))
    said = F.array_join(F.transform("ls", lambda x: x["said"]), " ")
    return rows.select("file", F.get("ls", F.lit(0))["line"].alias("line"), F.explode(sentences(said)).alias("text"))


def alternations(text: Column) -> Column:
    """Bracketed or back-ticked lists a|b|c of three parts at least, as arrays of parts."""
    found = F.regexp_extract_all(text, F.lit(r"[`(\[{<]([A-Za-z0-9_-]+(?:\s*\|\s*[A-Za-z0-9_-]+){2,})[`)\]}>]"), F.lit(1))
    return F.transform(found, lambda x: F.transform(F.split(x, r"\|"), lambda y: F.trim(y)))


def table_keys(text: Column) -> Column:
    """The first cells of the rows of pipe tables, without header and rule, back-ticks taken off."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*\|"))
    cells = F.transform(lines, lambda x: F.trim(F.regexp_replace(F.regexp_extract(x, r"^\s*\|([^|]*)\|", 1), "`", "")))
    rule = F.array_position(F.transform(cells, lambda c: c.rlike(r"^:?-{3,}:?$")), F.lit(True))
    return F.when(rule > 0, F.filter(F.slice(cells, rule + 1, F.size(cells)), lambda c: (c != "") & ~c.rlike(r"^:?-{3,}:?$"))).otherwise(F.array().cast("array<string>"))


def domain_sites(docs: DataFrame, least: int = 3) -> DataFrame:
    """(file, kind, keys): enumerated domains of docs(file, text) with `least` distinct keys."""
    clean = lambda c: F.array_sort(F.array_distinct(c))
    tables = docs.select("file", F.lit("md-table").alias("kind"), clean(table_keys(F.col("text"))).alias("keys"))
    lists = docs.select("file", F.lit("alternation").alias("kind"), F.explode(alternations(F.col("text"))).alias("k")).select("file", "kind", clean(F.col("k")).alias("keys"))
    return tables.unionByName(lists).where(F.size("keys") >= least)


def stripped(text: Column) -> Column:
    """Without white space at either end; null if nothing is left."""
    return F.nullif(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(""))


def section(text: Column, heading: str) -> Column:
    """The lines under `## heading` up to the next heading of that depth; empty for none."""
    return F.regexp_extract(F.concat(F.lit("\n"), text, F.lit("\n")), rf"(?s)\n##\s+{heading}[ \t]*\n(.*?)(?=\n##?\s|\z)", 1)


def bullets(block: Column) -> Column:
    """Texts of `- ` lines, escaped marks restored."""
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^\s*-\s+\S"))
    return F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"^-\s+", ""), r"\\([_*])", "$1"))


def spec(text: Column) -> Column:
    """struct<name, intent, claims, invariants, refutations> of a component's spec."""
    return F.struct(
        F.nullif(F.trim(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1)), F.lit("")).alias("name"),
        stripped(section(text, "intent")).alias("intent"),
        bullets(section(text, "claims")).alias("claims"),
        bullets(section(text, "invariants")).alias("invariants"),
        bullets(section(text, "refutations")).alias("refutations"),
    )


def zones(text: Column) -> Column:
    """array<struct<name, parent, intent>> of `- name inside parent: intent` bullets under zones."""
    pattern = r"^(\S+?)(?:\s+inside\s+(\S+?))?:\s*(.*)$"
    part = lambda x, i: F.nullif(F.regexp_extract(x, pattern, i), F.lit(""))
    return F.transform(F.filter(bullets(section(text, "zones")), lambda x: x.rlike(pattern)), lambda x: F.struct(part(x, 1).alias("name"), part(x, 2).alias("parent"), part(x, 3).alias("intent")))


def refuted(refutations: Column) -> Column:
    return F.array_distinct(F.transform(refutations, lambda x: F.trim(F.substring_index(x, ":", 1))))


def split_why(doc: Column) -> Column:
    """struct<what, why> around the first @why."""
    at = F.instr(doc, "@why")
    return F.struct(
        F.trim(F.when(at > 0, F.substring(doc, F.lit(1), at - 1)).otherwise(doc)).alias("what"),
        F.trim(F.when(at > 0, F.substring(doc, at + 4, F.lit(1 << 30))).otherwise(F.lit(""))).alias("why"),
    )


def splice(existing: Column, block: Column, begin: str, end: str) -> Column:
    """existing with what stands from begin to end replaced by block; null without such a region."""
    a = F.instr(existing, begin)
    tail = F.substring(existing, a + len(begin), F.lit(1 << 30))
    b = F.instr(tail, end)
    whole = F.concat(F.substring(existing, F.lit(1), a - 1), block, F.substring(tail, b + len(end), F.lit(1 << 30)))
    return F.when((a > 0) & (b > 0), whole)


def extract(existing: Column, begin: str, end: str) -> Column:
    """The region from begin to end, both included; null for none."""
    a = F.instr(existing, begin)
    tail = F.substring(existing, a, F.lit(1 << 30))
    b = F.instr(F.substring(tail, len(begin) + 1, 1 << 30), end)
    return F.when((a > 0) & (b > 0), F.substring(tail, F.lit(1), b + len(begin) + len(end) - 1))
