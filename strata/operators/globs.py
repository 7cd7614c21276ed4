"""Paths against many globs at once.

Globs are put into one trie over the segments of a path. A path walks it segment by segment, all paths at once:
each step is one equi-join of (state, key) with the trie's edges, where a segment's keys are its own text, "any
segment", and the wildcard patterns that fit it. So a path costs what the globs on its way cost, not what all of
them do. Which patterns fit is found once for each different segment, among those whose longest plain part it
contains.
"""

from __future__ import annotations

import itertools
import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.columns import glob_regex
from strata.operators.patterns import containing
from strata.sources.shared import materialize

#: Ways to write one glob with ** inside of segments; a glob with more is refused rather than cut.
WAYS = 1024
ANY = "*any"


def _ways(glob: str) -> list[tuple[str, ...]]:
    """The segment sequences that a glob stands for: ** alone is one segment or more, and inside a segment either a
    part of it or, where it spans separators, the end of one, any number between and the start of another."""
    options = []
    for segment in glob.split("/"):
        parts = re.split(r"\*\*+", segment)
        if parts == ["", ""]:
            options.append([("**",)])
            continue
        here = [(parts[0],)]
        for part in parts[1:]:
            here = [h[:-1] + t for h in here for t in ((f"{h[-1]}*{part}",), (f"{h[-1]}*", f"*{part}"), (f"{h[-1]}*", "**", f"*{part}"))]
        options.append(here)
        if len(here) > WAYS:
            raise ValueError(f"too many ** in {glob}")
    n = reduce(lambda a, b: a * len(b), options, 1)
    if n > WAYS:
        raise ValueError(f"too many ** in {glob}")
    return [tuple(itertools.chain(*way)) for way in itertools.product(*options)]


def _key(segment: str) -> str:
    plain = re.sub(r"\*+", "*", segment)
    return ANY if plain in ("*", "**") else f"~{plain}" if "*" in plain else f"={plain}"


def trie(globs: list[str]) -> tuple[list[tuple[int, str, int]], list[tuple[int, int]]]:
    """(edges (state, key, next), ends (state, number of the glob)); state 0 is the start."""
    after: dict[tuple[int, str, bool], int] = {}
    edges, ends, states = set(), set(), 1
    for number, glob in enumerate(globs):
        for way in _ways(glob):
            at = 0
            for segment in way:
                key, many = _key(segment), segment == "**"
                if (at, key, many) not in after:
                    after[at, key, many] = states
                    states += 1
                edges.add((at, key, after[at, key, many]))
                at = after[at, key, many]
                if many:
                    edges.add((at, key, at))
            ends.add((at, number))
    return sorted(edges), sorted(ends)


def _fitting(segments: DataFrame, patterns: list[str]) -> DataFrame:
    """(segment, keys): the wildcard patterns that fit each of segments(segment)."""
    spark = segments.sparkSession
    plain = spark.createDataFrame([(p, max(p.split("*"), key=len), glob_regex(p)) for p in patterns], "pattern string, name string, regex string")
    met = containing(plain.select("name"), segments.select(F.col("segment").alias("text"))).join(plain, "name").select(F.col("text").alias("segment"), "pattern", "regex")
    fits = met.where(F.expr("segment rlike regex")).groupBy("segment").agg(F.collect_set(F.concat(F.lit("~"), "pattern")).alias("keys"))
    return segments.join(fits, "segment", "left").select("segment", F.coalesce("keys", F.array().cast("array<string>")).alias("keys"))


def matching(paths: DataFrame, globs: list[str]) -> DataFrame:
    """(path, number): which of the globs fit each distinct of paths(path); a glob's number is its place in the list. Within a
    segment * is any run of characters; ** also crosses segments. A null path fits none."""
    spark = paths.sparkSession
    edges, ends = trie(globs)
    one = paths.select("path").where("path is not null").distinct().withColumn("segs", F.split("path", "/", -1))
    patterns = sorted({k[1:] for _, k, _ in edges if k.startswith("~")})
    cut = one.select("path", F.posexplode("segs").alias("i", "segment"))
    cut = materialize(cut.join(_fitting(cut.select("segment").distinct(), patterns), "segment").select("path", "i", F.concat(F.array(F.concat(F.lit("="), "segment"), F.lit(ANY)), "keys").alias("keys")), "segments")
    steps, last = spark.createDataFrame(edges, "state int, key string, next int"), spark.createDataFrame(ends, "state int, number int")
    depth = cut.agg(F.max("i")).first()[0]
    at, done = one.select("path", F.lit(0).alias("state"), F.size("segs").alias("n")), []
    for i in range(0 if depth is None else depth + 1):
        here = at.join(cut.where(F.col("i") == i).select("path", F.explode("keys").alias("key")), "path")
        at = materialize(here.join(steps, ["state", "key"]).select("path", F.col("next").alias("state"), "n").distinct(), "walk")
        done.append(at.where(F.col("n") == i + 1).join(last, "state").select("path", "number"))
    return reduce(DataFrame.unionByName, done).distinct() if done else spark.createDataFrame([], "path string, number int")


def first_match(paths: DataFrame, globs: list[str]) -> DataFrame:
    """(path, number): the first of the globs that fits each path; a path that none fits has no row."""
    return matching(paths, globs).groupBy("path").agg(F.min("number").alias("number"))
