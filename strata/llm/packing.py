"""Best-fit packing: local best fit, then a tree of merges over underfull bins.

Texts are tokenized where they are read; what goes on are pieces as numbers. A whole sequence is
final at once. The others are dealt by a hash of a number of their own to tasks of at most about
`task_pieces` pieces, so every task sees the table's mix of lengths whatever the order of the
input, and packs them by best fit, largest first. Nearly full bins are final. Underfull bins go
on as items of their own size: `fan` tasks meet in a group, which packs their bins by best fit
again, and so on until one group is left.

After best fit no two open bins of a task fit together, so all but one are more than half full.
Where `fan` tasks meet, a join of two bins needs one that is at most half full, and there are at most
`fan` of these. So a task hands on its `promoted` emptiest bins, more than `fan`, without giving up
a join, and no group grows with the table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import tokens
from strata.llm.memory import give_back
from strata.llm.store import materialize

_ITEM = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,ids:binary>"
_BIN = f"seat int, used int, sequence_id bigint, items array<{_ITEM}>"
_ITEM_ARROW_NAMES = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
_ITEM_ARROW = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
_PIECE = "number bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"
_PIECE_ARROW = pa.schema([("number", pa.int64()), *[(f.name, f.type) for f in _ITEM_ARROW]])
_BIN_ARROW = pa.schema([("seat", pa.int32()), ("used", pa.int32()), ("sequence_id", pa.int64()), ("items", pa.list_(_ITEM_ARROW))])


def best_fit(bins: list[tuple[int, list]], capacity: int) -> list[tuple[int, list]]:
    """Joins bins (used, items) by best fit, fullest first.

    One bit of `rooms` for each room that an open bin has; the lowest bit not below a size is the
    tightest fit.
    """
    rooms, open_ = 0, [[] for _ in range(capacity + 1)]
    out: list[tuple[int, list]] = []
    for used, items in sorted(bins, key=lambda b: -b[0]):
        fits = rooms >> used
        if fits:
            room = used + (fits & -fits).bit_length() - 1
            at = open_[room].pop()
            if not open_[room]:
                rooms &= ~(1 << room)
            out[at] = (out[at][0] + used, out[at][1] + items)
            left = room - used
        else:
            at, left = len(out), capacity - used
            out.append((used, items))
        if left:
            open_[left].append(at)
            rooms |= 1 << left
    return out


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole sequences, and a shorter piece before them."""
    if n <= length:
        return [(0, n)]
    head = n % length
    return ([(0, head)] if head else []) + [(i, length) for i in range(head, n, length)]


class Packer:
    """Bins of one task or group. Bins that become final get numbers of their own."""

    def __init__(self, level: int, seat: int, capacity: int, slack: int) -> None:
        self.base = (level << 58) | (seat << 28)
        self.n, self.capacity, self.slack = 0, capacity, slack
        self.open: list[tuple[int, list]] = []
        self.done: list[tuple[int, int, list]] = []

    def finish(self, used: int, items: list) -> None:
        self.done.append((used, self.base | self.n, items))
        self.n += 1

    def pack(self) -> None:
        bins, self.open = best_fit(self.open, self.capacity), []
        for used, items in bins:
            if used >= self.capacity - self.slack:
                self.finish(used, items)
            else:
                self.open.append((used, items))

    def keep(self, most: int) -> None:
        self.open.sort(key=lambda b: b[0])
        for used, items in self.open[most:]:
            self.finish(used, items)
        del self.open[most:]

    def table(self, seat: int) -> pa.Table:
        out = [(seat, used, number, items) for used, number, items in self.done] + [(seat, used, None, items) for used, items in self.open]
        return pa.table({n: pa.array([r[i] for r in out], f.type) for i, (n, f) in enumerate(zip(_BIN_ARROW.names, _BIN_ARROW, strict=True))}, schema=_BIN_ARROW)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    length: int = 1024,
    end_id: int = 2,
    doc_id: str = "doc_id",
    text: str = "text",
    keep_ids: bool = False,
    slack: int = 8,
    fan: int = 16,
    task_pieces: int = 1 << 17,
    promoted: int = 64,
) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids
    (little-endian unsigned 32-bit) if keep_ids.

    A text's tokens end with end_id; a null text is empty and so has one token. Texts longer than
    a sequence are cut into whole sequences, with the rest as first piece. Ids may be null or
    repeat; a repeated row is packed each time. Sequences are gapless; their numbers are unique and
    otherwise arbitrary. An empty table gives no rows; other columns play no part. A task holds the
    numbers of about task_pieces pieces (and their ids if keep_ids), whatever the table's size.
    """
    if promoted <= fan:
        raise ValueError("promoted must be more than fan")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seat, n = tokens.encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = []
                for key, said in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = encode(said or "")
                    ids.append(end_id)
                    load = ids.tobytes()
                    for piece, (start, used) in enumerate(cut(len(ids), length)):
                        own = load[4 * start : 4 * (start + used)]
                        rows.append(((seat << 32) | n, key, piece, start, used, zlib.crc32(own), own if keep_ids else None))
                        n += 1
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_PIECE_ARROW)], schema=_PIECE_ARROW)
        give_back()

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = materialize(source.mapInArrow(cut_up, _PIECE), "pack-pieces")
    short = pieces.where(F.col("length") < length)
    seats = max(1, -(-short.count() // task_pieces))

    def packed(level: int, last: bool):
        def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            seat = key[0].as_py()
            packer = Packer(level, seat, length, slack)
            packer.open = list(zip(table.column("used").to_pylist(), table.column("items").to_pylist(), strict=True))
            packer.pack()
            packer.keep(0 if last else promoted)
            return packer.table(seat)

        return merge

    dealt = short.select(
        F.pmod(F.xxhash64("number"), F.lit(seats)).cast("int").alias("seat"), F.col("length").cast("int").alias("used"),
        F.array(F.struct(*[F.col(c) for c in _ITEM_ARROW_NAMES])).alias("items"),
    )
    done, level = [], 0
    while True:
        level += 1
        last = seats == 1
        bins = materialize(dealt.groupBy("seat").applyInArrow(packed(level, last), _BIN), f"pack-{level}")
        done.append(bins.where("sequence_id is not null"))
        if last:
            break
        seats = -(-seats // fan)
        dealt = bins.where("sequence_id is null").select(F.floor(F.col("seat") / F.lit(fan)).cast("int").alias("seat"), "used", "items")
    closed = done[0]
    for more in done[1:]:
        closed = closed.unionByName(more)
    # Offsets run over the items of a sequence in their order.
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
    offsets = F.aggregate(
        F.transform("items", lambda x: x["length"]),
        start,
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        lambda acc: acc["out"],
    )
    placed = closed.select("sequence_id", F.explode(F.arrays_zip(F.col("items"), offsets.alias("offset"))).alias("x"))
    names = ("doc_id", "piece", "start", "length", "ids_crc32", *(("ids",) if keep_ids else ()))
    placed = placed.select(*[F.col(f"x.items.{c}").alias(c) for c in names], "sequence_id", F.col("x.offset").alias("offset"))
    # Whole sequences have numbers below 2^58, those of packers begin there.
    whole = pieces.where(F.col("length") == length).select(*names, F.col("number").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return whole.unionByName(placed).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if keep_ids else []))
