"""Near-duplicate classes: ProbMinHash signatures, banding, exact verification, components.

Shingles are runs of five words. Each weighted shingle is a Poisson process whose arrivals each
hit one register; a register keeps the shingle that arrived first, so two registers agree with the
probability Jaccard similarity of the weights. Here every shingle of a text weighs the same however
often it occurs: then that similarity is the Jaccard similarity of the sets of shingles, which is
what pairs are verified by, and the bands miss no more than is said below. Arrivals are drawn up
to a horizon at which all registers of a text are expected to be filled, later only for texts
with empty registers: what arrives after the last register was filled can't win any more.

Texts with equal words are one node, with a number of its own: ids may repeat. Nodes that share a band are candidates. Of each band bucket
the hub is the node with the most neighbours over all its bands; a node belongs to the groups of
its hubs, so nodes that share a bucket share a group, and a family of copies is a few groups
instead of all pairs. A group is dealt to blocks of bounded size that each also hold the hub.
Inside a block all pairs are verified with the exact Jaccard similarity of the sets of shingles.
Nodes that this ties to the hub are settled; every pair of blocks of which one has unsettled
nodes is compared in turn. So no candidate pair is lost: it is either compared, or both of its
nodes are already tied to the hub. What leaves a block is a forest, never all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import words as W
from strata.llm.memory import give_back
from strata.llm.components import components
from strata.llm.store import materialize

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(column: pa.ChunkedArray | pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes, text of each, words of each text, 2 hashes of each text's words).

    A text with fewer than `width` words, but one at least, has the run of all its words as its
    only shingle.
    """
    offsets, data = W.text_bytes(column)
    hashes, counts = W.word_hashes(offsets, data)
    at, text = W.places(counts, width)
    found = [W.runs(hashes, width)[at]]
    owner = [text]
    begins = np.cumsum(counts) - counts
    for n in range(1, width):
        short = np.flatnonzero(counts == n)
        if len(short):
            found.append(W.runs(hashes, n)[begins[short]])
            owner.append(short)
    s, t = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(t, kind="stable")
    up, down = W.powers()[1](len(hashes) + 1)
    whole = []
    for salt in (np.uint64(0), np.uint64(0xA0761D6478BD642F)):
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(W.mix(hashes ^ salt) * up[: len(hashes)], dtype=np.uint64, out=total[1:])
        whole.append(W.mix((total[begins + counts] - total[begins]) * down[begins] + counts.astype(np.uint64) + salt))
    return s[order], t[order], counts, np.stack(whole, 1)


def prob_minhash(s: np.ndarray, text: np.ndarray, n_texts: int, registers: int, *, counted: bool = True) -> np.ndarray:
    """(n_texts, registers) of 32-bit shingle hashes; the registers of a text without shingles are all ones.

    A shingle's weight is 1 + ln(count) if counted, else 1.
    """
    out = np.full(n_texts * registers, _EMPTY)
    if len(s):
        key = np.sort((text.astype(np.uint64) << np.uint64(44)) | (s >> np.uint64(20)))
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        weight = 1.0 + np.log(np.diff(np.r_[first, len(key)])) if counted else np.ones(len(first))
        key = key[first]
        text = (key >> np.uint64(44)).astype(np.int64)
        element = W.mix((key & np.uint64((1 << 44) - 1)) + _STEP)
        mass = np.bincount(text, weight, n_texts)
        horizon = registers * (np.log(registers) + 3.0) / np.maximum(mass, 1e-300)

        def wait(which: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(time until the next arrival, register that it hits)."""
            r = W.mix(element[which] + (turn.astype(np.uint64) + np.uint64(1)) * _STEP)
            uniform = ((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            return -np.log(uniform) / weight[which], (W.mix(r) % np.uint64(registers)).astype(np.int64)

        turn = np.zeros(len(element), np.int64)
        time, slot = wait(np.arange(len(element)), turn)
        low = element & np.uint64(0xFFFFFFFF)
        while True:
            now = np.flatnonzero(time <= horizon[text])
            while len(now):
                bits = time[now].astype(np.float32).view(np.uint32).astype(np.uint64)
                np.minimum.at(out, text[now] * registers + slot[now], (bits << np.uint64(32)) | low[now])
                turn[now] += 1
                more, slot[now] = wait(now, turn[now])
                time[now] += more
                now = now[time[now] <= horizon[text[now]]]
            short = (out.reshape(n_texts, registers) == _EMPTY).any(1) & (mass > 0)
            if not short.any():
                break
            horizon = np.where(short, 2 * horizon, -1.0)
    return (out & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(n_texts, registers)


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """(n_texts, bands) of 64-bit keys; equal for equal rows of the same band only."""
    n, rows = signature.shape[0], signature.shape[1] // bands
    parts = signature.astype(np.uint64).reshape(n, bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _STEP, (n, bands)).copy()
    for r in range(rows):
        key = W.mix(key ^ (parts[:, :, r] + np.uint64(((r + 1) * int(_STEP)) & W._MASK)))
    return key


class Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def tie(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def similar(column: pa.ChunkedArray, width: int, at_least: float, left: np.ndarray, right: np.ndarray, piece: int = 8192) -> np.ndarray:
    """Pairs (i in left, j in right) of texts whose sets of shingles have that Jaccard similarity.

    Intersections are products of 0/1 matrices over `piece` shingles at a time; shingles of one
    text only are counted in sizes and left out of the products.
    """
    s, text, _, _ = shingles(column, width)
    order = np.lexsort((text, s))
    s, text = s[order], text[order]
    new = np.r_[True, (s[1:] != s[:-1]) | (text[1:] != text[:-1])] if len(s) else np.zeros(0, bool)
    s, text = s[new], text[new]
    size = np.bincount(text, minlength=len(column))
    first = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
    number = np.cumsum(first) - 1
    shared = np.bincount(number)[number] > 1 if len(s) else np.zeros(0, bool)
    text, number = text[shared], number[shared]
    _, number = np.unique(number, return_inverse=True)
    row, col = np.full(len(column), -1), np.full(len(column), -1)
    row[left], col[right] = np.arange(len(left)), np.arange(len(right))
    both = np.zeros((len(left), len(right)), np.float32)
    for a in range(0, int(number.max()) + 1 if len(number) else 0, piece):
        x, y = np.searchsorted(number, (a, a + piece))
        t, c = text[x:y], number[x:y] - a
        m1, m2 = np.zeros((len(left), piece), np.float32), np.zeros((len(right), piece), np.float32)
        m1[row[t[row[t] >= 0]], c[row[t] >= 0]] = 1
        m2[col[t[col[t] >= 0]], c[col[t] >= 0]] = 1
        both += m1 @ m2.T
    union = size[left][:, None] + size[right][None, :] - both
    i, j = np.nonzero((both > 0) & (both >= at_least * union))
    return np.stack([left[i], right[j]], 1)


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", **how) -> DataFrame:
    """(doc_id, nd_class) for each row of docs: the least id of the class that the row is in.

    Other arguments and the classes are those of classes(). If an id has several texts, each of its
    rows is in the class of its own text, and classes with the same least id have the same nd_class;
    classes() tells them apart.
    """
    return classes(docs, doc_id=doc_id, **how).select(doc_id, "nd_class")


def classes(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = 5,
    at_least: float = 0.8,
    bands: int = 24,
    rows: int = 6,
    block_texts: int = 256,
    block_words: int = 1 << 20,
) -> DataFrame:
    """(doc_id, nd_text, nd_group, nd_class) for each row of docs: xxhash64 of the text, a number that the
    rows of a class have in common and no others (arbitrary; null for a class of one row as said
    below), and the least id of the class.

    Words are runs of characters other than the space and 09 to 0D, unchanged. Two texts are
    linked if the Jaccard similarity of their sets of five-word shingles is at_least 0.8 or more,
    or their words are equal; classes are connected. At a similarity of 0.8 the 24 bands of 6
    registers miss a pair with a probability of 0.0007, and less above. A text without words
    (null, empty) is a class of its own; so is every row with a null id, whose class is null.
    Rows with the same id and text are in one class; rows with the same id and different texts are
    so only if their texts are linked. An empty table gives no rows. Other columns of docs play no part.
    A block holds about block_texts texts and block_words words, whichever is less, and its hub.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                s, owner, counts, whole = shingles(part.column(1), width)
                keys = band_keys(prob_minhash(s, owner, part.num_rows, bands * rows, counted=False), bands)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array(whole[:, 0].view(np.int64)),
                        pa.array(whole[:, 1].view(np.int64)),
                        pa.array(counts),
                        pa.ListArray.from_arrays(np.arange(part.num_rows + 1, dtype=np.int32) * bands, pa.array(keys.reshape(-1).view(np.int64))),
                    ],
                    ["id", "said", "h1", "h2", "n", "keys"],
                )
        give_back()

    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("said"))
    signed = materialize(source.mapInArrow(sign, "id long, said long, h1 long, h2 long, n long, keys array<long>"), "nd-signed")
    nodes = signed.where("n > 0 and id is not null").groupBy("h1", "h2").agg(F.min(F.struct("id", "said")).alias("least"), F.first("keys").alias("keys"), F.first("n").alias("n"))
    nodes = materialize(nodes.select(F.monotonically_increasing_id().alias("node"), "least.id", "least.said", "h1", "h2", "keys", "n"), "nd-nodes")

    keyed = nodes.select("node", "n", F.explode("keys").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = materialize(keyed.join(buckets, "key"), "nd-met")
    rank = met.groupBy("node").agg(F.sum("size").alias("degree"))
    ranked = met.join(rank, "node").withColumn("rank", F.struct("degree", -F.col("node")))
    hubs = ranked.groupBy("key").agg(F.max_by("node", "rank").alias("hub"))
    members = materialize(met.join(hubs, "key").select("hub", "node", "n").distinct(), "nd-members")

    blocks = F.greatest(F.ceil(F.count("*") / F.lit(float(block_texts))), F.ceil(F.sum("n") / F.lit(float(block_words))))
    sizes = members.groupBy("hub").agg(blocks.cast("int").alias("blocks"))
    homes = members.drop("n").join(sizes, "hub").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    guests = sizes.where("blocks > 1").select("hub", F.col("hub").alias("node"), "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    rows_ = homes.select("hub", "node", "blocks", "block").unionByName(guests).distinct()
    wanted = members.select("node").distinct().join(nodes.select("node", "id", "said"), "node")
    # Sorted and merged at every size: a side that is small enough to broadcast here grows with the input.
    texts = materialize(source.where("id is not null").join(wanted.hint("merge"), ["id", "said"]).groupBy("id", "said", "node").agg(F.max("text").alias("text")).select("node", "text"), "nd-texts")
    with_text = lambda df: df.join(texts, "node")

    def tied(table: pa.Table, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, Forest]:
        nodes_ = table.column("node").to_numpy()
        forest = Forest(len(nodes_))
        for i, j in pairs.tolist():
            forest.tie(i, j)
        return nodes_, np.array([forest.root(i) for i in range(len(nodes_))], np.int64), forest

    def within(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        every = np.arange(table.num_rows)
        ids, roots, forest = tied(table, similar(table.column("text"), width, at_least, every, every))
        hub = np.flatnonzero(ids == key[0].as_py())
        settled = roots == (forest.root(int(hub[0])) if len(hub) else -1)
        return pa.table({"hub": pa.array([key[0].as_py()] * len(ids), pa.int64()), "block": pa.array([key[1].as_py()] * len(ids), pa.int32()), "blocks": table.column("blocks"), "a": pa.array(ids), "b": pa.array(ids[roots] if len(ids) else ids), "settled": pa.array(settled)})

    first = materialize(
        with_text(rows_).select("hub", "block", "blocks", "node", "text").groupBy("hub", "block").applyInArrow(within, "hub long, block int, blocks int, a long, b long, settled boolean"),
        "nd-within",
    )

    # Blocks of one group against each other, once for each pair of which one has unsettled nodes.
    split = first.where("blocks > 1 and (a <> hub or block = pmod(xxhash64(hub), blocks))").select("hub", "block", "blocks", F.col("a").alias("node"), "settled")
    loose = split.where("not settled").select("hub", F.col("block").alias("from"), "blocks").distinct()
    pairs = (
        loose.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .where("from <> to")
        .select("hub", F.least("from", "to").alias("x"), F.greatest("from", "to").alias("y"))
        .distinct()
    )
    sides = pairs.select("hub", "x", "y", F.explode(F.array("x", "y")).alias("block"))
    across_rows = with_text(sides.join(split, ["hub", "block"]).select("hub", "x", "y", "block", "node", "settled"))

    def across(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        block, settled = table.column("block").to_numpy(), table.column("settled").to_numpy(zero_copy_only=False)
        x, y = np.flatnonzero(block == key[1].as_py()), np.flatnonzero(block == key[2].as_py())
        found = similar(table.column("text"), width, at_least, x, y)
        found = found[~(settled[found[:, 0]] & settled[found[:, 1]])]
        ids, roots, _ = tied(table, found)
        moved = roots != np.arange(len(ids))
        return pa.table({"a": pa.array(ids[moved], pa.int64()), "b": pa.array(ids[roots[moved]], pa.int64())})

    second = across_rows.select("hub", "x", "y", "block", "node", "settled", "text").groupBy("hub", "x", "y").applyInArrow(across, "a long, b long")
    edges = first.where("a <> b").select("a", "b").unionByName(second)
    roots = components(edges, "nd-components")

    least = nodes.select("node", "id").join(roots, "node").groupBy("root").agg(F.min("id").alias("class"))
    found = nodes.select("node", "id", "h1", "h2").join(roots.join(least, "root"), "node", "left")
    found = found.select("h1", "h2", F.coalesce("root", "node").alias("group"), F.coalesce("class", "id").alias("class"))
    alone = (F.col("n") == 0) | F.col("id").isNull()
    return (
        signed.select("id", "said", "h1", "h2", "n")
        .join(found, ["h1", "h2"], "left")
        .select(
            F.col("id").alias(doc_id),
            F.col("said").alias("nd_text"),
            F.when(~alone, F.col("group")).alias("nd_group"),
            F.when(alone, F.col("id")).otherwise(F.col("class")).alias("nd_class"),
        )
    )
