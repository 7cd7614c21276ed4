"""Many names sought in many texts at once.

Few names are dealt to automata of a bounded size; texts go past them in groups of a bounded size, once for each
automaton. Where that is more work than the lengths of names ask for, texts say the hashes of all their pieces
of these lengths, and names join them: the cost follows texts and names, not their product.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.sources.shared import large, materialize, partitions

#: Bytes of names in one automaton, and of texts that one task holds.
AUTOMATON, GROUP = 1 << 20, 16 << 20
_FOUND = "text string, names array<string>"


def _find(names: pa.Table, texts: pa.Table) -> pa.Table:
    """Each text with the distinct names it contains, if any."""
    said, found = [], []
    if names.num_rows and texts.num_rows:
        automaton = ahocorasick.Automaton()
        for name in names.column("name").to_pylist():
            automaton.add_word(name, name)
        automaton.make_automaton()
        for text in texts.column("text").to_pylist():
            if held := {name for _, name in automaton.iter(text)}:
                said.append(text)
                found.append(sorted(held))
    return pa.table([pa.array(said, pa.string()), pa.array(found, pa.list_(pa.string()))], ["text", "names"])


#: Bytes of text of which a task says the pieces at once, and the most lengths of names it says them for.
LOAD, LENGTHS = 1 << 20, 4096
#: An odd base, its inverse modulo 2^64, and a number for each byte.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256).astype(np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)])


def _pieces(texts: list[bytes], lengths: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length (places in texts, hashes) of all pieces of texts that are so many bytes long."""
    sizes, data = np.array([len(t) for t in texts], np.int64), np.frombuffer(b"".join(texts), np.uint8)
    of = np.repeat(np.arange(len(texts)), sizes)
    left = np.cumsum(sizes)[of] - np.arange(len(data))
    sums = np.cumsum(np.r_[np.uint64(0), _BYTES[data] * _powers(_BASE, len(data))[:-1]])
    back = _powers(_INVERSE, len(data))
    for n in lengths:
        at = np.flatnonzero(left >= n)
        yield of[at], ((sums[at + n] - sums[at]) * back[at] ^ np.uint64(n)).view(np.int64)


def _loads(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """(from, up to) of runs of texts of at most LOAD bytes, or of one text."""
    at, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > LOAD:
            yield at, i
            at, held = i, 0
        held += len(text)
    yield at, len(texts)


def _by_pieces(few: DataFrame, said: DataFrame, lengths: list[int]) -> DataFrame:
    """containing() by a join of names with the pieces of said(text, at) that are as long as a name. Other
    pieces may have a name's hash, so every pair is looked at in the end."""

    def say(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = [t.encode() for t in batch.column("text").to_pylist()], batch.column("at").to_numpy()
            for start, upto in _loads(texts):
                for places, hashes in _pieces(texts[start:upto], lengths):
                    yield pa.record_batch([pa.array(hashes), pa.array(at[start:upto][places])], ["hash", "at"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[int, list[bytes]] = {}
            for name in batch.column("name").to_pylist():
                by.setdefault(len(name.encode()), []).append(name.encode())
            for n, names in by.items():
                yield pa.record_batch([pa.array([x.decode() for x in names], pa.string()), pa.array(next(_pieces(names, [n]))[1])], ["name", "hash"])

    names = few.select("name").mapInArrow(whole, "name string, hash long")
    met = said.select("text", "at").mapInArrow(say, "hash long, at long").join(large(names), "hash").select("hash", "name", "at").distinct()
    return met.join(large(said), "at").where(F.contains("text", "name")).select("name", "text")


def containing(names: DataFrame, texts: DataFrame, *, automaton: int = AUTOMATON, group: int = GROUP) -> DataFrame:
    """(name, text): which of the distinct texts(text) contain which of the distinct names(name).
    A null or empty name is in none, a null text contains none."""
    few = materialize(names.select("name").where("length(name) > 0").distinct(), "names")
    said = materialize(texts.select("text").where("text is not null").distinct().withColumn("at", F.monotonically_increasing_id()), "texts")
    size = lambda df, c: df.agg(F.coalesce(F.sum(F.octet_length(c)), F.lit(0))).first()[0]
    named, read = size(few, "name"), size(said, "text")
    shards = -(-named // automaton) or 1
    groups = max(partitions(names), -(-read // group))
    # Names go to every group and texts past every automaton, or texts say pieces of every length.
    most = min((named * groups + read * shards) // (4 * read), LENGTHS) if read else 0
    lengths = [r.n for r in few.select(F.octet_length("name").alias("n")).distinct().limit(most + 1).collect()]
    if 0 < len(lengths) <= most:
        return _by_pieces(few, said, lengths)
    dealt = few.select("name", F.pmod(F.xxhash64("name"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
    past = said.select("text", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("text"), F.lit(groups)).cast("int").alias("part"))
    met = dealt.groupBy("shard", "part").cogroup(past.groupBy("shard", "part")).applyInArrow(_find, _FOUND)
    return met.select(F.explode("names").alias("name"), "text")
