"""Substring dedup: seed with winnowed anchors, compare what stands around joined ones, keep maximal repeats.

Every `width` consecutive words hold `width - seed + 1` runs of `seed` words; the least hash of
these is their anchor. Equal runs of `width` words have equal anchors, so whatever repeats over the
length threshold is seeded, and a text has about 2 anchors for every width - seed + 2 words. Four
steps, each over blocks of texts that one shuffle deals out by a hash of the id (the shuffle is
reused):

1. seeds: each block sends its distinct anchors to the buckets of their hashes;
2. join: a bucket answers each block with those anchors that two texts have;
3. extend: of each joined anchor a block takes the runs of `width` words that hold it, l words to the
   left and width - seed - l to the right, for every l that keeps it the anchor, and sends each run once
   with the least id that has it there; a bucket answers with those that a smaller id has elsewhere;
4. cover: a matched run is a repeat of `width` words; those that overlap or adjoin are one maximal
   repeat, whose words go. What a block has twice itself is found among all of its runs, seeds or not.

A match isn't grown word by word and pair by pair: runs are compared by hash, so the texts that share an
anchor fall into groups that share a run around it, and a group of any size is one row for each block. So a passage that a
third of all texts share costs each block one row, and no pairs of texts are ever made. Blocks
hold about `block_bytes` of input, and buckets are as many as the shuffle has partitions or the
input asks for. A block does work by its words and by the buckets that it meets, never by all.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm import words as W
from strata.llm.memory import give_back
from strata.llm.store import input_bytes, partitions

_SENT = "sd_bucket int, sd_block int, sd_load binary"
_ANSWER = "sd_block int, sd_load binary"


def _anchored(runs: np.ndarray, at: np.ndarray, width: int, seed: int) -> np.ndarray:
    """The anchor of the window that starts at each place of `at`."""
    if not len(at):
        return np.zeros(0, np.uint64)
    least = runs[at]
    for k in range(1, width - seed + 1):
        np.minimum(least, runs[at + k], out=least)
    # A least hash is small; mixed again it spreads over the buckets.
    return W.mix(least + np.uint64(0x632BE59BD9B4E019))


class Block:
    """The windows of the texts of one block. Texts with a null id take no part."""

    def __init__(self, table: pa.Table, doc_id: str, text: str, width: int, seed: int) -> None:
        self.ids = table.column(doc_id).to_numpy(zero_copy_only=False) if table.column(doc_id).null_count == 0 else None
        self.valid = np.ones(table.num_rows, bool)
        if self.ids is None:
            self.valid = ~np.asarray(table.column(doc_id).is_null())
            self.ids = table.column(doc_id).fill_null(0).to_numpy(zero_copy_only=False)
        self.ids = self.ids.astype(np.int64)
        offsets, data = W.text_bytes(table.column(text))
        self.hashes, self.counts = W.word_hashes(offsets, data)
        self.at, self.doc = W.places(self.counts, width)
        keep = self.valid[self.doc]
        self.at, self.doc = self.at[keep], self.doc[keep]
        self.width, self.seed = width, seed

    def anchors(self) -> np.ndarray:
        return _anchored(W.runs(self.hashes, self.seed), self.at, self.width, self.seed)

    def extended(self, which: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the runs of `width` words (those of `which`), each with its anchor inside."""
        return W.runs(self.hashes, self.width)[self.at if which is None else self.at[which]]


def _least(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, least id of each, whether more than one id has it)."""
    order = np.argsort(keys, kind="stable")
    k, i = keys[order], ids[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    if not len(first):
        return k, i, np.zeros(0, bool)
    low, high = np.minimum.reduceat(i, first), np.maximum.reduceat(i, first)
    return k[first], low, low != high


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Hashes to buckets by their highest bits, in the order of the hashes."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _pieces(of: np.ndarray) -> np.ndarray:
    """Bounds of the stretches of equal numbers of a sorted array."""
    return np.r_[np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), len(of)] if len(of) else np.zeros(1, np.int64)


def _sent(block: int, keys: np.ndarray, buckets: int, *more: np.ndarray) -> pa.Table:
    """For each bucket that has some of the sorted keys a row of them; `more` are columns of the keys,
    written after them."""
    of = _bucket(keys, buckets)
    cut = _pieces(of)
    loads = [b"".join(x[a:b].tobytes() for x in (keys, *more)) for a, b in itertools.pairwise(cut)]
    return pa.table({"sd_bucket": pa.array(of[cut[:-1]].astype(np.int32), pa.int32()), "sd_block": pa.array([block] * len(loads), pa.int32()), "sd_load": pa.array(loads, pa.binary())})


def _answers(blocks: np.ndarray, keys: np.ndarray) -> pa.Table:
    order = np.lexsort((keys, blocks))
    blocks, keys = blocks[order], keys[order]
    cut = _pieces(blocks)
    return pa.table({"sd_block": pa.array(blocks[cut[:-1]].astype(np.int32), pa.int32()), "sd_load": pa.array([keys[a:b].tobytes() for a, b in itertools.pairwise(cut)], pa.binary())})


def _gathered(table: pa.Table) -> np.ndarray:
    """All keys of the answers to one block."""
    return np.unique(np.frombuffer(b"".join(table.column("sd_load").to_pylist()), np.uint64)) if table.num_rows else np.zeros(0, np.uint64)


def _among(keys: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(sorted_set, keys)
    at[at == len(sorted_set)] = 0
    return sorted_set[at] == keys


def dedup_substrings(docs: DataFrame, *, width: int = 13, seed: int = 7, doc_id: str = "doc_id", text: str = "text", block_bytes: int = 6 << 20) -> DataFrame:
    """docs plus sd_n_words, sd_n_removed, sd_spans (array of the removed runs: first word, end
    word) and sd_kept (the words that stay, joined by one space).

    Every word goes that a window of `width` words covers whose sequence also starts in a text
    with a smaller id; windows are judged on the input. A null text has no words. Texts with a
    null id neither lose words nor make others lose them; rows with equal ids don't affect each
    other. Windows are compared by 64-bit hashes. A very long text is one row of one block. An empty
    table gives no rows. Columns of docs stay; one with a name of the result's is overwritten.
    """
    spark_parts = partitions(docs)
    n_blocks = max(3 * spark_parts, -(-(input_bytes(docs) or 0) // block_bytes))
    n_buckets = max(spark_parts, n_blocks // 3)
    made = ("sd_n_words", "sd_n_removed", "sd_spans", "sd_kept")
    rows = docs.drop(*[c for c in made if c not in (doc_id, text)])
    # Columns go by number between the steps, so no name of the input can clash with one of the steps.
    fields = rows.schema.fields
    plain = [f"c{i}" for i in range(len(fields))]
    id_, text_ = plain[rows.columns.index(doc_id)], plain[rows.columns.index(text)]
    dealt = rows.toDF(*plain).withColumn("sd_block", F.pmod(F.xxhash64(id_), F.lit(n_blocks)).cast("int"))

    def seeds(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        b = Block(table, id_, text_, width, seed)
        keys, _, many = _least(b.anchors(), b.ids[b.doc])
        give_back()
        return _sent(key[0].as_py(), keys, n_buckets, many.astype(np.uint8))

    def join(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        loads, blocks = table.column("sd_load").to_pylist(), table.column("sd_block").to_numpy()
        sizes = np.array([len(x) // 9 for x in loads], np.int64)
        keys = np.concatenate([np.frombuffer(x, np.uint64, n) for x, n in zip(loads, sizes, strict=True)])
        many = np.concatenate([np.frombuffer(x, np.uint8, n, 8 * n) for x, n in zip(loads, sizes, strict=True)]).astype(bool)
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        same = k[1:] == k[:-1]
        shared = many[order] | np.r_[same, False] | np.r_[False, same]
        return _answers(np.repeat(blocks, sizes)[order][shared], k[shared])

    def extend(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows or not answers.num_rows:
            return _sent(0, np.zeros(0, np.uint64), n_buckets, np.zeros(0, np.int64))
        b = Block(table, id_, text_, width, seed)
        chosen = _among(b.anchors(), _gathered(answers))
        keys, low, _ = _least(b.extended(chosen), b.ids[b.doc[chosen]])
        give_back()
        return _sent(key[0].as_py(), keys, n_buckets, low)

    def earliest(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        loads, blocks = table.column("sd_load").to_pylist(), table.column("sd_block").to_numpy()
        sizes = np.array([len(x) // 16 for x in loads], np.int64)
        keys = np.concatenate([np.frombuffer(x, np.uint64, n) for x, n in zip(loads, sizes, strict=True)])
        ids = np.concatenate([np.frombuffer(x, np.int64, n, 8 * n) for x, n in zip(loads, sizes, strict=True)])
        order = np.argsort(keys, kind="stable")
        k, i = keys[order], ids[order]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        low = np.repeat(np.minimum.reduceat(i, first), np.diff(np.r_[first, len(k)]))
        late = low < i
        return _answers(np.repeat(blocks, sizes)[order][late], k[late])

    kept_schema = T.StructType(
        [
            *[T.StructField(n, f.dataType) for n, f in zip(plain, fields, strict=True)],
            T.StructField("sd_n_words", T.LongType()),
            T.StructField("sd_n_removed", T.LongType()),
            T.StructField("sd_spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))),
            T.StructField("sd_kept", T.StringType()),
        ]
    )

    def cover(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        b = Block(table, id_, text_, width, seed)
        keys = b.extended()
        own, low, _ = _least(keys, b.ids[b.doc])
        repeated = _among(keys, _gathered(answers))
        if len(keys):
            repeated |= low[np.searchsorted(own, keys)] < b.ids[b.doc]
        edge = np.zeros(len(b.hashes) + 1, np.int64)
        np.add.at(edge, b.at[repeated], 1)
        np.add.at(edge, b.at[repeated] + width, -1)
        gone = np.cumsum(edge[:-1]) > 0
        begins = np.cumsum(b.counts) - b.counts
        removed = np.add.reduceat(np.r_[gone, False].astype(np.int64), begins) if len(begins) else np.zeros(0, np.int64)
        removed[b.counts == 0] = 0
        spans, kept = [], []
        offsets, data = W.text_bytes(table.column(text_))
        for i in range(table.num_rows):
            ws = data[offsets[i] : offsets[i + 1]].tobytes().split()
            if removed[i]:
                mask = gone[begins[i] : begins[i] + b.counts[i]]
                turns = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
                spans.append([{"first": int(x), "end": int(y)} for x, y in zip(turns[::2], turns[1::2], strict=True)])
                ws = itertools.compress(ws, (~mask).tolist())
            else:
                spans.append([])
            kept.append(b" ".join(ws))
        span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        out = table.select(plain)
        for name, column in (
            ("sd_n_words", pa.array(b.counts)),
            ("sd_n_removed", pa.array(removed)),
            ("sd_spans", pa.array(spans, span)),
            ("sd_kept", pa.array(kept, pa.binary()).cast(pa.string())),
        ):
            out = out.append_column(name, column)
        give_back()
        return out

    by_block = lambda df: df.groupBy("sd_block")
    joined = by_block(dealt).applyInArrow(seeds, _SENT).groupBy("sd_bucket").applyInArrow(join, _ANSWER)
    late = by_block(dealt).cogroup(by_block(joined)).applyInArrow(extend, _SENT).groupBy("sd_bucket").applyInArrow(earliest, _ANSWER)
    return by_block(dealt).cogroup(by_block(late)).applyInArrow(cover, kept_schema).toDF(*rows.columns, *made)
