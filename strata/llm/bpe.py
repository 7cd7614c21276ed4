"""BPE encoding with reuse of content-defined chunks across texts, and decoding.

A rolling hash over 16 bytes cuts a text where its bits say so, so texts that share a passage
share the chunks inside it. Of a chunk, the words that lie wholly inside it are its core. A core
that several texts have is encoded once:

1. bundles: texts are put together in bundles of a few megabytes, compressed, with their cuts;
2. seeds: each bundle sends the digests of its cores to buckets; a bucket elects of the bundles
   that share a core the one that owns it;
3. owners encode what they own and send the ids to the buckets, which hand them on to all that
   share the core;
4. each bundle encodes the cores that are its alone, and puts the texts together.

Bundles are shuffled once; of texts nothing else moves but 16 bytes for each core and the ids of
shared ones. Buckets belong to wards of at most about `ward_bytes` of input, and a core is encoded once
in each ward: so what meets in a bucket is bounded, however many texts share a passage.

The word at a join of two chunks is repaired: the join is re-encoded together with its neighbours,
first one word on either side, then more, until the encoding begins and ends exactly as the
encodings of the cores do there; if it never does, the whole text is encoded.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm import tokens
from strata.llm import words as W
from strata.llm.memory import give_back
from strata.llm.store import input_bytes, partitions

ROLL = 16


class Memory:
    """What was put in last or asked for lately, in two generations of at most `size` entries."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


def segments(buf: np.ndarray, chunk_bits: int) -> list[tuple[int, int, bool]]:
    """(start, end, is a core) of the parts of a text's bytes, in order, without gaps.

    A part after the first begins at white space (a byte of 09 to 0D or the space), so that no
    word is in two parts.
    """
    n = len(buf)
    if n <= ROLL:
        return [(0, n, True)] if n else []
    up, down = W.powers()[0](n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(W.BYTE_VALUES[buf] * up[:n], dtype=np.uint64, out=total[1:])
    rolled = W.mix((total[ROLL:] - total[:-ROLL]) * down[: n - ROLL + 1])
    cuts = np.flatnonzero(rolled >> np.uint64(64 - chunk_bits) == 0) + ROLL
    space = np.flatnonzero((buf == 32) | ((buf >= 9) & (buf <= 13)))
    out, at = [], 0
    # The join at a cut runs from the last white space before it to the first at or after it.
    i = np.searchsorted(space, cuts)
    for c, k in zip(cuts.tolist(), i.tolist(), strict=True):
        a = int(space[k - 1]) if k else 0
        b = int(space[k]) if k < len(space) else n
        if c >= n or b <= at:
            continue
        a = max(a, at)
        if out and not out[-1][2] and a == at:
            out[-1] = (out[-1][0], b, False)
        else:
            if a > at:
                out.append((at, a, True))
            out.append((a, b, False))
        at = b
    if at < n:
        out.append((at, n, True))
    return out


class Codec:
    def __init__(self, path: str, chunk_bits: int) -> None:
        self.tokenizer, self.chunk_bits = tokens.tokenizer(path), chunk_bits
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.numbers = [str(i) for i in range(size)]
        self.plain = self.tokenizer.decoder is None
        self.joins, self.few = Memory(1 << 14), Memory(1 << 15)
        self.wide = np.uint32 if size > 1 << 16 else np.uint16
        self.encoded = self.reused = self.repaired = 0
        self.batch = tokens.batch_encoder(path)

    def _encode(self, texts: list[bytes]) -> list[list[int]]:
        self.encoded += len(texts)
        return self.batch([t.decode() for t in texts])

    def _some(self, text: bytes) -> list[int]:
        """Ids of a few words."""
        found = self.few.get(text)
        if found is None:
            found = self._encode([text])[0]
            self.few.put(text, found)
        return found

    @staticmethod
    def _words_back(buf: bytes, at: int, low: int, n: int) -> int:
        for _ in range(n):
            if at <= low:
                break
            at -= 1
            while at > low and buf[at] not in b" \t\n\x0b\x0c\r":
                at -= 1
        return at

    @staticmethod
    def _words_on(buf: bytes, at: int, high: int, n: int) -> int:
        for _ in range(n):
            if at >= high:
                break
            at += 1
            while at < high and buf[at] not in b" \t\n\x0b\x0c\r":
                at += 1
        return at

    def _repair(self, buf: bytes, a: int, b: int, low: int, high: int, left: list[int], right: list[int]) -> list[int] | None:
        """Ids of buf[a:b] between the cores buf[low:a] and buf[b:high] with ids left and right;
        None without agreement."""
        n = 1
        while True:
            x, y = self._window(buf, a, b, low, high, n)
            window = buf[x:y]
            key = (window, a - x, b - x)
            found = self.joins.get(key)
            if found is None:
                found = self._join(self._encode([window])[0], self._some(buf[x:a]) if x < a else [], self._some(buf[b:y]) if b < y else [])
                self.joins.put(key, found)
            if found:
                middle, before, after = found
                if left[len(left) - len(before) :] == before and right[: len(after)] == after:
                    self.repaired += 1
                    return middle
            if x <= low and y >= high:
                return None
            n *= 4

    def _window(self, buf: bytes, a: int, b: int, low: int, high: int, n: int) -> tuple[int, int]:
        return self._words_back(buf, a, low, n), self._words_on(buf, b, high, n)

    def _join(self, whole: list[int], before: list[int], after: list[int]) -> tuple:
        """What a window says about its join; () if it doesn't begin and end as its words do."""
        middle = whole[len(before) : len(whole) - len(after)]
        return (middle, before, after) if before + middle + after == whole and len(before) + len(after) <= len(whole) else ()

    def _ahead(self, texts: list[bytes], cut: list) -> None:
        """Encodes the smallest window of every join that isn't known, in one call."""
        wanted: dict[tuple, None] = {}
        few: dict[bytes, None] = {}
        for t, parts in zip(texts, cut, strict=True):
            for k, (a, b, core) in enumerate(parts):
                if not core:
                    x, y = self._window(t, a, b, parts[k - 1][0] if k else a, parts[k + 1][1] if k + 1 < len(parts) else b, 1)
                    key = (t[x:y], a - x, b - x)
                    if self.joins.get(key) is None:
                        wanted[key] = None
                        few.update(dict.fromkeys(p for p in (t[x:a], t[b:y]) if p and self.few.get(p) is None))
        for p, ids in zip(few, self._encode(list(few)), strict=True):
            self.few.put(p, ids)
        for key, whole in zip(wanted, self._encode([w for w, _, _ in wanted]), strict=True):
            window, a, b = key
            self.joins.put(key, self._join(whole, self._some(window[:a]) if a else [], self._some(window[b:]) if b < len(window) else []))

    def encode(self, texts: list[bytes], cut: list[list[tuple[int, int, bool]]], cores: dict[bytes, list[int]]) -> tuple[list[list[list[int]]], list[int]]:
        """(for each text the ids of its parts, how many of its cores were new). `cores` holds the cores that
        are known, and after this the new ones too, which are encoded in one call."""
        new: dict[bytes, None] = {}
        fresh = []
        for t, parts in zip(texts, cut, strict=True):
            before = len(new)
            for a, b, core in parts:
                if core:
                    piece = t[a:b]
                    if piece in cores or piece in new:
                        self.reused += 1
                    else:
                        new[piece] = None
            fresh.append(len(new) - before)
        cores.update(zip(new, self._encode(list(new)), strict=True))
        self._ahead(texts, cut)
        out = []
        for t, parts in zip(texts, cut, strict=True):
            found: list[list[int]] | None = []
            for k, (a, b, core) in enumerate(parts):
                if core:
                    found.append(cores[t[a:b]])
                    continue
                low, left = (parts[k - 1][0], found[-1]) if k else (a, [])
                high, right = (parts[k + 1][1], cores[t[parts[k + 1][0] : parts[k + 1][1]]]) if k + 1 < len(parts) else (b, [])
                middle = self._repair(t, a, b, low, high, left, right)
                if middle is None:
                    found = None
                    break
                found.append(middle)
            out.append([self._encode([t])[0]] if found is None else found)
        return out, fresh

    def decode(self, ids: list[int]) -> str:
        """As the tokenizer's decode(ids, skip_special_tokens=False)."""
        if self.plain:
            return " ".join(map(self.names.__getitem__, ids))
        return self.tokenizer.decode(ids, skip_special_tokens=False)


@functools.cache
def codec(path: str, chunk_bits: int) -> Codec:
    return Codec(path, chunk_bits)


#: What encode_decode can return beside n_tokens.
OUTPUTS = {
    "bpe_ids": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
    "bpe_decoded": (T.StringType(), pa.string()),
    "bpe_ids_sha256": (T.StringType(), pa.string()),
    "bpe_decoded_sha256": (T.StringType(), pa.string()),
    "bpe_new_chunks": (T.LongType(), pa.int64()),
}

_BUNDLE = "bpe_block bigint, bpe_ward int, bpe_rows binary, bpe_cuts binary, bpe_keys binary"
_SEEDS = "bpe_ward int, bpe_bucket int, bpe_block bigint, bpe_load binary"
_ELECTED = "bpe_ward int, bpe_bucket int, bpe_block bigint, bpe_owned boolean, bpe_load binary"
_CODED = "bpe_ward int, bpe_bucket int, bpe_load binary"
_HANDED = "bpe_block bigint, bpe_load binary"


def _table(schema: str, columns: list[list]) -> pa.Table:
    names = [x.split() for x in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip(names, columns, strict=True)})


def digest(piece: bytes) -> bytes:
    return hashlib.blake2b(piece, digest_size=16).digest()


def _by_bucket(keys: list[bytes], buckets: int) -> list[tuple[int, list[bytes]]]:
    """Sorted digests by the bucket that their first four bytes say."""
    return [(b, list(ks)) for b, ks in itertools.groupby(sorted(keys), lambda k: int.from_bytes(k[:4], "big") * buckets >> 32)]


def _cut_load(keys: bytes, size: int = 16) -> list[bytes]:
    return [keys[i : i + size] for i in range(0, len(keys), size)]


def _coded(keys: list[bytes], ids: list[list[int]], wide) -> bytes:
    """A load of digests and the ids of each."""
    lengths = np.array([len(x) for x in ids], np.uint32)
    flat = np.fromiter(itertools.chain.from_iterable(ids), wide, int(lengths.sum()))
    return len(keys).to_bytes(4, "little") + b"".join(keys) + lengths.tobytes() + flat.tobytes()


def _decoded(load: bytes, wide) -> Iterator[tuple[bytes, np.ndarray]]:
    n = int.from_bytes(load[:4], "little")
    lengths = np.frombuffer(load, np.uint32, n, 4 + 16 * n)
    flat = np.frombuffer(load, wide, -1, 4 + 20 * n)
    ends = np.cumsum(lengths, dtype=np.int64)
    for k, (end, size) in enumerate(zip(ends.tolist(), lengths.tolist(), strict=True)):
        yield load[4 + 16 * k : 20 + 16 * k], flat[end - size : end]


def _texts(rows: pa.RecordBatch, at: int) -> list[bytes]:
    return [t or b"" for t in rows.column(at).cast(pa.binary()).to_pylist()]


def _opened(table: pa.Table, at: int) -> tuple[pa.RecordBatch, list[bytes], list[list[tuple[int, int, bool]]]]:
    """(rows, texts, cuts) of the one bundle of a group; texts are the rows' column `at`."""
    rows = pa.ipc.open_stream(pa.decompress(table.column("bpe_rows")[0].as_buffer()[8:], int.from_bytes(table.column("bpe_rows")[0].as_buffer()[:8], "little"), "zstd")).read_next_batch()
    texts = _texts(rows, at)
    numbers = np.frombuffer(table.column("bpe_cuts")[0].as_buffer(), np.int32)
    counts, rest = numbers[: len(texts)].tolist(), numbers[len(texts) :].reshape(-1, 2).tolist()
    parts = iter([(a, b >> 1, bool(b & 1)) for a, b in rest])
    return rows, texts, [list(itertools.islice(parts, n)) for n in counts]


def encode_decode(
    docs: DataFrame, tokenizer_path: str, *, text: str = "text", outputs: tuple[str, ...] = ("bpe_ids", "bpe_decoded"), chunk_bits: int = 9,
    bundle_bytes: int = 4 << 20, ward_bytes: int = 16 << 30,
) -> DataFrame:
    """docs plus bpe_n_tokens and the `outputs`: ids, the text decoded from them, the digests of both
    (ids as decimal numbers joined by one space), and how many chunks were encoded for this text alone
    or as the first of those that share them.

    Ids are those of the tokenizer file for the whole text, without added special tokens,
    truncation and padding. A null text counts as empty and has no ids. Every row is encoded by its
    text alone, so repeated rows have equal results (but for the new chunks); an empty table gives no
    rows. Chunks have about 2^chunk_bits bytes. A text longer than bundle_bytes is a bundle of its own.
    Columns of docs stay; one with a name of the result's is overwritten.
    """
    made = ["bpe_n_tokens", *outputs]
    taken = [f for f in docs.schema.fields if f.name not in made or f.name == text]
    # Columns go by number between the steps, so no name of the input can clash with one of the steps.
    plain, said = [f"c{i}" for i in range(len(taken))], [f.name for f in taken].index(text)
    back = [i for i, f in enumerate(taken) if f.name not in made]
    schema = T.StructType([*[T.StructField(plain[i], taken[i].dataType) for i in back], T.StructField("bpe_n_tokens", T.LongType()), *[T.StructField(c, OUTPUTS[c][0]) for c in outputs]])
    source = docs.select(*[f.name for f in taken]).toDF(*plain)
    size = input_bytes(docs) or 0
    wards = max(1, -(-size // ward_bytes))
    buckets = max(1, -(-partitions(docs) // wards), min(128, -(-size // (128 << 20))))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            lengths = np.diff(W.text_bytes(batch.column(said))[0])
            at = 0
            while at < batch.num_rows:
                end = at + max(1, int(np.searchsorted(np.cumsum(lengths[at:]), bundle_bytes, "right")))
                rows = batch.slice(at, end - at)
                at = end
                texts = _texts(rows, said)
                cuts = [segments(np.frombuffer(t, np.uint8), chunk_bits) for t in texts]
                keys = {digest(t[a:b]) for t, parts in zip(texts, cuts, strict=True) for a, b, core in parts if core}
                numbers = np.array([len(c) for c in cuts] + [x for c in cuts for a, b, core in c for x in (a, 2 * b + core)], np.int32)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema) as w:
                    w.write_batch(rows)
                raw = sink.getvalue()
                load = raw.size.to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)
                block = (part << 32) | n
                n += 1
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([int(W.mix(np.array([block], np.uint64))[0]) % wards], pa.int32()), pa.array([load], pa.binary()), pa.array([numbers.tobytes()], pa.binary()), pa.array([b"".join(sorted(keys))], pa.binary())], ["bpe_block", "bpe_ward", "bpe_rows", "bpe_cuts", "bpe_keys"])
        give_back()

    def seeds(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ward, found = table.column("bpe_ward")[0].as_py(), _by_bucket(_cut_load(table.column("bpe_keys")[0].as_py()), buckets)
        return _table(_SEEDS, [[ward] * len(found), [b for b, _ in found], [key[0].as_py()] * len(found), [b"".join(ks) for _, ks in found]])

    def elect(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        blocks, loads = table.column("bpe_block").to_numpy(), table.column("bpe_load").to_pylist()
        keys = np.frombuffer(b"".join(loads), ">u8").reshape(-1, 2)
        of = np.repeat(blocks, [len(x) // 16 for x in loads])
        order = np.lexsort((of, keys[:, 1], keys[:, 0]))
        keys, of = keys[order], of[order]
        same = (keys[1:] == keys[:-1]).all(axis=1)
        shared, first = np.r_[same, False] | np.r_[False, same], ~np.r_[False, same]
        rows = []
        for owned in (True, False):
            which = np.flatnonzero(shared & (first == owned))
            which = which[np.argsort(of[which], kind="stable")]
            edges = np.r_[np.flatnonzero(np.r_[True, np.diff(of[which]) != 0]), len(which)] if len(which) else np.zeros(1, np.int64)
            rows += [(int(of[which[a]]), owned, keys[which[a:b]].tobytes()) for a, b in itertools.pairwise(edges.tolist())]
        return _table(_ELECTED, [[key[0].as_py()] * len(rows), [key[1].as_py()] * len(rows), *[[r[i] for r in rows] for i in range(3)]])

    def own(key: tuple[pa.Scalar, ...], table: pa.Table, mine: pa.Table) -> pa.Table:
        if not table.num_rows or not mine.num_rows:
            return _table(_CODED, [[], [], []])
        c, wanted = codec(tokenizer_path, chunk_bits), set(_cut_load(b"".join(mine.column("bpe_load").to_pylist())))
        _, texts, cuts = _opened(table, said)
        found: dict[bytes, bytes] = {}
        for t, parts in zip(texts, cuts, strict=True):
            for a, b, core in parts:
                if core and (d := digest(t[a:b])) in wanted:
                    found[d] = t[a:b]
        ids = dict(zip(found, c._encode(list(found.values())), strict=True))
        rows = _by_bucket(list(found), buckets)
        give_back()
        return _table(_CODED, [[table.column("bpe_ward")[0].as_py()] * len(rows), [b for b, _ in rows], [_coded(ks, [ids[k] for k in ks], c.wide) for _, ks in rows]])

    def hand_on(key: tuple[pa.Scalar, ...], elected: pa.Table, coded: pa.Table) -> pa.Table:
        wide = codec(tokenizer_path, chunk_bits).wide
        ids = {k: x for load in coded.column("bpe_load").to_pylist() for k, x in _decoded(load, wide)}
        loads = []
        for load in elected.column("bpe_load").to_pylist():
            ks = _cut_load(load)
            loads.append(_coded(ks, [ids[k].tolist() for k in ks], wide))
        marked = [bytes([o]) + x for o, x in zip(elected.column("bpe_owned").to_pylist(), loads, strict=True)]
        return _table(_HANDED, [elected.column("bpe_block").to_pylist(), marked])

    def put_together(key: tuple[pa.Scalar, ...], table: pa.Table, handed: pa.Table) -> pa.Table:
        c = codec(tokenizer_path, chunk_bits)
        number = c.numbers.__getitem__
        rows, texts, cuts = _opened(table, said)
        known: dict[bytes, tuple[bool, list[int]]] = {}
        for load in handed.column("bpe_load").to_pylist():
            known.update((k, (bool(load[0]), x.tolist())) for k, x in _decoded(load[1:], c.wide))
        cores: dict[bytes, list[int]] = {}
        columns: dict[str, list] = {x: [] for x in made}
        for at in range(0, len(texts), 128):
            some, some_cuts = texts[at : at + 128], cuts[at : at + 128]
            first = [0] * len(some)
            if known:
                for i, (t, parts) in enumerate(zip(some, some_cuts, strict=True)):
                    for a, b, core in parts:
                        if core and (piece := t[a:b]) not in cores and (hit := known.get(digest(piece))):
                            cores[piece] = hit[1]
                            first[i] += hit[0]
            encoded, fresh = c.encode(some, some_cuts, cores)
            for pieces, new in zip(encoded, map(sum, zip(first, fresh, strict=True)), strict=True):
                ids = [i for p in pieces for i in p]
                columns["bpe_n_tokens"].append(len(ids))
                if "bpe_new_chunks" in columns:
                    columns["bpe_new_chunks"].append(new)
                if "bpe_ids" in columns:
                    columns["bpe_ids"].append(ids)
                if "bpe_ids_sha256" in columns:
                    columns["bpe_ids_sha256"].append(hashlib.sha256(" ".join(map(number, ids)).encode()).hexdigest())
                if "bpe_decoded" in columns or "bpe_decoded_sha256" in columns:
                    read = c.decode(ids)
                    if "bpe_decoded" in columns:
                        columns["bpe_decoded"].append(read)
                    if "bpe_decoded_sha256" in columns:
                        columns["bpe_decoded_sha256"].append(hashlib.sha256(read.encode()).hexdigest())
        arrays = [pa.array(columns["bpe_n_tokens"], pa.int64()), *[pa.array(columns[x], OUTPUTS[x][1]) for x in outputs]]
        give_back()
        return pa.Table.from_arrays([rows.column(i) for i in back] + arrays, [*[plain[i] for i in back], *made])

    by_block = lambda df: df.groupBy("bpe_block")
    by_bucket = lambda df: df.groupBy("bpe_ward", "bpe_bucket")
    bundles = source.mapInArrow(bundle, _BUNDLE)
    elected = by_bucket(by_block(bundles).applyInArrow(seeds, _SEEDS)).applyInArrow(elect, _ELECTED)
    coded = by_block(bundles).cogroup(by_block(elected.where("bpe_owned"))).applyInArrow(own, _CODED)
    handed = by_bucket(elected).cogroup(by_bucket(coded)).applyInArrow(hand_on, _HANDED)
    out = by_block(bundles).cogroup(by_block(handed)).applyInArrow(put_together, schema)
    return out.toDF(*[taken[i].name for i in back], *made)
