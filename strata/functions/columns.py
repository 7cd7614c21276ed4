"""Reusable column builders. All are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """rows plus a column whose value is computed once for each row.

    Of a generator's output no filter or later column can pull the expression behind it down
    or repeat it, as the optimizer does with the columns of a projection.
    """
    return rows.select("*", F.explode(F.array(value)).alias(name))


def round2(x: Column) -> Column:
    """Half up on the binary value, as floor(100 x + 0.5) / 100; round() would round the decimal text."""
    return F.floor(x * F.lit(100.0) + F.lit(0.5)) / F.lit(100.0)


def normalize_words(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def shingles(words: Column, k: int = 6) -> Column:
    """Distinct runs of k words joined by a space; none for fewer than k words."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.array_join(F.slice(words, i, k), " "))
    return F.when(n >= k, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def content_id(prefix: str, digits: int, *parts: Column) -> Column:
    """prefix and the first hex digits of the SHA-256 of the parts joined by NUL; a null part is empty."""
    joined = F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, digits))


def slug(raw: Column, size: int = 40) -> Column:
    """A label safe as a file name; one that had to change ends with a part of its hash."""
    safe = F.substring(F.regexp_replace(F.regexp_replace(raw, "[^A-Za-z0-9._-]+", "-"), "^[-.]+|[-.]+$", ""), 1, size)
    return F.when(safe == raw, raw).otherwise(F.concat(safe, F.lit("-"), F.substring(F.sha2(raw, 256), 1, 8)))


def family_of(key: Column) -> Column:
    return F.substring_index(key, "|", 1)


def last_number(text: Column) -> Column:
    """The last number in a text; null without one."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1)), F.lit(-1)).cast("double")


# What the paths of tests look like to a reading of a change, and to a reading of a context.
TEST_PATH = r"\.(test|spec)\.[mc]?[jt]sx?$|(^|/)__tests__/|(^|/)test_[^/]*\.py$|_test\.py$"
TEST_LIKE = r"(^|/)(__tests__|test|tests)(/|$)|\.(test|spec)\.[^/]+$"


def is_test_path(path: Column) -> Column:
    return F.coalesce(path.rlike(TEST_PATH), F.lit(False))


def looks_like_test(path: Column) -> Column:
    """In any case of letters; a component's spec in markdown isn't a test."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return F.coalesce(~p.endswith(".spec.md") & p.rlike(TEST_LIKE), F.lit(False))


def glob_regex(glob: str) -> str:
    """An anchored pattern: ** crosses path segments, * doesn't; all else stands for itself."""
    out, i = "^", 0
    while i < len(glob):
        if glob[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*"}.get(glob[i]) or (f"\\{glob[i]}" if not (glob[i].isalnum() or glob[i] in "_/") else glob[i])
            i += 1
    return out + "$"


def clip(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


#: The eight heights of a series, lowest first.
BARS = "▁▂▃▄▅▆▇█"


def sparkline(values: Column, low: Column, high: Column) -> Column:
    """One of eight bars for each value between low and high; the lowest where there is no span."""
    span = F.when(high > low, high - low)
    index = lambda v: F.least(F.lit(7), F.greatest(F.lit(0), F.floor((v - low) / span * F.lit(7.0) + F.lit(0.5)))).cast("int")
    bar = lambda v: F.substring(F.lit(BARS), F.coalesce(index(v), F.lit(0)) + 1, F.lit(1))
    return F.array_join(F.transform(values, bar), "")


def trend(first: Column, last: Column, eps: float) -> Column:
    return F.when(last - first > eps, "▲").when(first - last > eps, "▼").otherwise("▬")


def heat_cell(heat: Column, most: Column, width: int = 10) -> Column:
    """A bar and a percentage; empty where the symbol is unknown, which isn't the same as cold."""
    n = F.when(most > 0, F.floor(heat / most * F.lit(float(width)) + F.lit(0.5)).cast("int")).otherwise(F.lit(0))
    said = F.concat(F.repeat(F.lit("█"), n), F.lit(" "), F.floor(heat * 100 + 0.5).cast("string"), F.lit("%"))
    return F.when(heat.isNull(), F.lit("")).otherwise(said)


def human_age(seconds: Column) -> Column:
    """Whole seconds, minutes, hours or days."""
    s = F.greatest(seconds, F.lit(0)).cast("long")
    said = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(unit))
    return F.when(s < 60, said(1, "s")).when(s < 3600, said(60, "m")).when(s < 86400, said(3600, "h")).otherwise(said(86400, "d"))


def sorted_set(array: Column) -> Column:
    return F.array_sort(F.array_distinct(array))


def pair_key(a: Column, b: Column) -> Column:
    """The same text whichever of the two comes first."""
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def ref_parts(ref: Column) -> Column:
    """struct<kind, id> of `kind:id`, cut at the first colon; null parts without one."""
    at = F.instr(ref, ":")
    return F.struct(
        F.when(at > 1, F.substring(ref, F.lit(1), at - 1)).alias("kind"),
        F.when(at > 1, F.substring(ref, at + 1, F.lit(1 << 30))).alias("id"),
    )


def local_parts(at: Column, zone: str = "UTC") -> Column:
    """struct<y, md, hm, hms> of a UTC time text on the clock of a zone; null for what isn't a time."""
    t = F.from_utc_timestamp(F.try_to_timestamp(at), zone)
    said = lambda f: F.date_format(t, f)
    return F.when(t.isNotNull(), F.struct(said("yyyy").alias("y"), said("MM-dd").alias("md"), said("HH:mm").alias("hm"), said("HH:mm:ss").alias("hms")))


def format_when(at: Column, now: Column, zone: str = "UTC") -> Column:
    """How long ago a time text was, within a day; else its date and time in the zone; what isn't a time as it is."""
    t = F.try_to_timestamp(at)
    s = F.unix_timestamp(now) - F.unix_timestamp(t)
    ago = lambda n, unit: F.concat(_text(n), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    day = F.date_format(F.from_utc_timestamp(t, zone), "MMM d, yyyy · HH:mm")
    past = s >= 0
    return F.when(t.isNull(), at).when(past & (s < 60), ago(s, "second")).when(past & (s < 3600), ago(F.floor(s / 60), "minute")).when(past & (s < 86400), ago(F.floor(s / 3600), "hour")).otherwise(day)


def _text(c: Column) -> Column:
    return c.cast("string")


def site_subject(file: Column, kind: Column, name: Column, keys: Column) -> Column:
    """What a site is called wherever it stands: one that is named by its line is named by its keys."""
    by_keys = F.concat(F.regexp_extract(name, r"^(.*)@\d+$", 1), F.lit("#"), F.substring(F.sha2(F.array_join(keys, "\0"), 256), 1, 6))
    return F.concat(file, F.lit("#"), kind, F.lit(":"), F.when(name.rlike(r"@\d+$"), by_keys).otherwise(name))


def unit_subject(file: Column, words: Column) -> Column:
    return F.concat(file, F.lit("#prose:"), F.substring(F.sha2(F.array_join(words, " "), 256), 1, 6))


def finding_key(advisory: Column, subject: Column) -> Column:
    return F.concat(advisory, F.lit(":"), subject)


def context_path(raw: Column) -> Column:
    """A path with slashes, without what leads nowhere."""
    return F.regexp_replace(F.regexp_replace(F.replace(F.trim(raw), F.lit("\\"), F.lit("/")), r"^\./", ""), "/{2,}", "/")
