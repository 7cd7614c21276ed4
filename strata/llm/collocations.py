"""Phrase collocations by counting suffixes (suffix-sigma) and joining phrases with their parts.

Every word begins one suffix of at most max_n words of its piece. Suffixes are shuffled by language
and first word, so all that begin alike meet; sorted in reverse lexicographic order, each closes the
prefixes that it doesn't share with the one before, and one stack of max_n counters holds all that is
open. The counts of phrases of any length come from the one pass. Rows between the steps are loads:
the distinct suffixes of some megabytes of text with their counts, as numbers into a vocabulary that
goes along.

A first word may begin a third of all suffixes. Prefixes that a sample shows to be frequent are dealt
by one word more (and so on, up to whole suffixes); what is then counted in several buckets is
summed afterwards. The sample steers only where rows go: the result is the same without it. A load
never goes to more than FAN buckets at once; where there are more, groups of buckets come first.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm import words as W
from strata.llm.memory import give_back
from strata.llm.store import input_bytes, materialize, partitions

#: Bytes of text that one load is made of, buckets that one load is dealt to at once, frequent prefixes of one length at most.
SLICE, FAN, HOT = 2 << 20, 1024, 1 << 16
UNKNOWN = "und"
_LOADS = "co_bucket int, co_depth int, co_load binary"
_PHRASES = "lang string, phrase string, words int, f long"
_ABSENT = np.uint64(0x2545F4914F6CDD1D)

# What ends a piece (2) and what only parts words (1). All are ASCII, so in UTF-8 no other character has these bytes.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


@functools.cache
def _powers() -> W.Powers:
    return W.Powers(np.uint64(0x9E3779B97F4A7C15))


def hashes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each stretch of bytes; the stretches are in order and don't overlap. About a megabyte at a time."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + W.SLICE_BYTES, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        up, down = _powers()(b - a + 1)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(W.BYTE_VALUES[data[a:b]] * up[: b - a], dtype=np.uint64, out=total[1:])
        at, end = starts[i:j] - a, ends[i:j] - a
        out[i:j] = W.mix((total[end] - total[at]) * down[at] + (end - at).astype(np.uint64))
        i = j
    return out


def ranges(offsets: np.ndarray, data: np.ndarray, size: int):
    """(first text, end text, first byte, end byte) of stretches of about `size` bytes. Only between
    pieces is a text cut that is longer than that."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        a, b = int(offsets[i]), int(offsets[j])
        if b - a > size and j == i + 1:
            ends = a + np.flatnonzero(_KIND[data[a:b]] == 2)
            while (k := int(np.searchsorted(ends, a + size))) < len(ends):
                yield i, j, a, int(ends[k])
                a = int(ends[k])
        yield i, j, a, b
        i = j


class Suffixes:
    """Distinct suffixes with their counts: rows of numbers (language, then words; 0: none) into a vocabulary
    given as the length of each entry and the bytes of all. Numbers count from 1."""

    def __init__(self, rows: np.ndarray, counts: np.ndarray, lengths: np.ndarray, said: bytes) -> None:
        self.rows, self.counts, self.lengths, self.said = rows, counts, lengths, said
        self.ends = np.cumsum(lengths)

    @classmethod
    def of_texts(cls, offsets: np.ndarray, data: np.ndarray, langs: np.ndarray, names: list[bytes], max_n: int) -> Suffixes:
        """Suffixes of texts (offsets from 0), in lower case; langs are numbers into names."""
        upper = (data >= 65) & (data <= 90)
        data = data + upper.astype(np.uint8) * np.uint8(32)
        kind = _KIND[data]
        inside = kind == 0
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        piece = (kind == 2).astype(np.int32)
        piece[edges] += 1
        piece = np.cumsum(piece)[starts]
        text = np.searchsorted(offsets, starts, "right") - 1
        _, at, number = np.unique(hashes_of(data, starts, ends), return_index=True, return_inverse=True)
        n = len(starts)
        rows = np.zeros((n, max_n + 1), np.uint32)
        rows[:, 0] = langs[text] + 1
        rows[:, 1] = number + (len(names) + 1)
        for k in range(1, max_n):
            if n > k:
                rows[:-k, k + 1] = np.where(piece[k:] == piece[:-k], rows[k:, 1], 0)
        lengths = np.r_[np.array([len(x) for x in names], np.int64), ends[at] - starts[at]]
        texts = data.tobytes()
        said = b"".join([*names, *[texts[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]])
        return cls(rows, np.ones(n, np.int64), lengths, said)

    @classmethod
    def of_loads(cls, loads: list[bytes]) -> Suffixes:
        """What several loads hold, over one vocabulary in the order of its bytes."""
        sizes, heads, rows, counts, lengths, datas = [], [], [], [], [], []
        for load in loads:
            n, v, width, kind = np.frombuffer(load, np.uint32, 4).tolist()
            lengths.append(np.frombuffer(load, np.uint32, v, 16).astype(np.int64))
            at = 16 + 4 * v
            counts.append(np.frombuffer(load, np.int64, n, at))
            at += 8 * n
            ids = np.frombuffer(load, np.uint32 if kind == 4 else np.uint16, n * width, at)
            rows.append(ids.reshape(width, n).T)
            datas.append(np.frombuffer(load, np.uint8, -1, at + kind * n * width))
            sizes.append(n)
            heads.append(v)
        size = np.concatenate(lengths)
        entries = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.r_[0, np.cumsum(size)].tobytes()), pa.py_buffer(np.concatenate(datas).tobytes())]).dictionary_encode()
        known = entries.dictionary
        order = np.asarray(pc.sort_indices(known))
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(1, len(order) + 1, dtype=np.uint32)
        number = place[np.asarray(entries.indices)]
        out = np.zeros((sum(sizes), rows[0].shape[1]), np.uint32)
        at = base = 0
        for r, v in zip(rows, heads, strict=True):
            out[at : at + len(r)] = np.r_[np.uint32(0), number[base : base + v]][r]
            at, base = at + len(r), base + v
        known = known.take(order)
        offsets = np.frombuffer(known.buffers()[1], np.int64)[known.offset : known.offset + len(known) + 1]
        return cls(out, np.concatenate(counts), np.diff(offsets), known.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]])

    def merged(self) -> Suffixes:
        """Distinct rows in descending order, with the sums of their counts."""
        n, width = self.rows.shape
        if not n:
            return self
        bits = max(1, len(self.lengths).bit_length())
        each = 64 // bits
        keys = []
        for a in range(0, width, each):
            key = np.zeros(n, np.uint64)
            for c in range(a, min(width, a + each)):
                key = key << np.uint64(bits) | self.rows[:, c]
            keys.append(key)
        order = (np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1]))[::-1]
        changed = np.zeros(n - 1, bool)
        for key in keys:
            key = key[order]
            changed |= key[1:] != key[:-1]
        firsts = np.r_[0, np.flatnonzero(changed) + 1]
        return Suffixes(self.rows[order[firsts]], np.add.reduceat(self.counts[order], firsts), self.lengths, self.said)

    def prefix_hashes(self) -> list[np.ndarray]:
        """Of each row the hash of its language and first word, of that and the second, and so on."""
        h = np.r_[_ABSENT, hashes_of(np.frombuffer(self.said, np.uint8), self.ends - self.lengths, self.ends)]
        out, last = [], W.mix(h[self.rows[:, 0]])
        for c in range(1, self.rows.shape[1]):
            last = W.mix(last * np.uint64(0xD1342543DE82EF95) + h[self.rows[:, c]])
            out.append(last)
        return out

    def dealt(self, buckets: int, per: int, hot: list[np.ndarray]) -> pa.RecordBatch:
        """A load for each (bucket // per, depth) that some rows fall to: by the hash of as many words (depth)
        as it takes to reach a prefix that isn't hot."""
        prefixes = self.prefix_hashes()
        depth, key = np.ones(len(self.rows), np.int32), prefixes[0].copy()
        for k, among in enumerate(hot, 1):
            more = (depth == k) & np.isin(prefixes[k - 1], among)
            depth[more] += 1
            key[more] = prefixes[k][more]
        bucket = (((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64) // per
        place = bucket * (len(hot) + 2) + depth
        order = np.argsort(place, kind="stable")
        cut = np.r_[np.flatnonzero(np.r_[True, np.diff(place[order]) != 0]), len(order)] if len(order) else np.zeros(1, np.int64)
        made = [order[a:b] for a, b in itertools.pairwise(cut)]
        heads = [x[0] for x in made]
        return pa.RecordBatch.from_arrays([pa.array(bucket[heads].astype(np.int32)), pa.array(depth[heads]), pa.array([self._load(x) for x in made], pa.binary())], ["co_bucket", "co_depth", "co_load"])

    def _load(self, which: np.ndarray) -> bytes:
        of = self.rows[which].T
        used, rows = np.unique(of, return_inverse=True)
        rows = rows.reshape(of.shape)
        if len(used) and used[0] == 0:
            used = used[1:]
        else:
            rows = rows + 1
        kind = 2 if len(used) < 1 << 16 else 4
        a, b = (self.ends - self.lengths)[used - 1].tolist(), self.ends[used - 1].tolist()
        said = b"".join([self.said[x:y] for x, y in zip(a, b, strict=True)])
        head = np.array([len(which), len(used), self.rows.shape[1], kind], np.uint32)
        return b"".join([head.tobytes(), self.lengths[used - 1].astype(np.uint32).tobytes(), self.counts[which].tobytes(), rows.astype(np.uint16 if kind == 2 else np.uint32).tobytes(), said])


class Stack:
    """The open prefixes of suffixes that come in reverse lexicographic order: one frame for each column, with
    the count so far. A row closes all frames from the first column on in which it differs from the last."""

    def __init__(self, width: int) -> None:
        self.last, self.counts = np.zeros(width, np.uint32), np.zeros(width, np.int64)

    def push(self, rows: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """What the rows close: for each frame, (prefixes, padded to whole rows, counts)."""
        out, differs = [], np.zeros(len(rows), bool)
        before = np.vstack([self.last, rows[:-1]])
        for c in range(rows.shape[1]):
            differs |= rows[:, c] != before[:, c]
            at = np.flatnonzero(differs)
            sums = np.add.reduceat(counts, np.r_[0, at]) if not len(at) or at[0] else np.r_[0, np.add.reduceat(counts, at)]
            sums[0] += self.counts[c]
            self.counts[c] = sums[-1]
            out.append((before[at], sums[:-1]))
        self.last = rows[-1]
        return out

    def close(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(self.last[None, :], self.counts[c : c + 1]) for c in range(len(self.last))]


def _slices(batches, max_n: int, size: int):
    """Suffixes of stretches of the texts of Arrow batches (lang, text)."""
    for batch in batches:
        coded = batch.column(0).fill_null(UNKNOWN).dictionary_encode()
        langs, names = np.asarray(coded.indices).astype(np.uint32), [x.encode() for x in coded.dictionary.to_pylist()]
        offsets, data = W.text_bytes(batch.column(1))
        for i, j, a, b in ranges(offsets, data, size):
            yield Suffixes.of_texts(np.clip(offsets[i : j + 1], a, b) - a, data[a:b], langs[i:j], names, max_n)
            give_back()


def frequent_prefixes(texts: DataFrame, max_n: int, buckets: int, share: float) -> list[np.ndarray]:
    """For lengths of 1 to max_n - 1 words the hashes of prefixes that begin more than a quarter of a bucket's
    fair share of the suffixes of a sample; the HOT most frequent if there are more, so that any other
    begins fewer than one in HOT."""

    def counted(batches):
        for s in _slices(batches, max_n, SLICE):
            least = max(2, len(s.rows) // (16 * buckets))
            out = [(0, 0, len(s.rows))]
            for k, h in enumerate(s.prefix_hashes()[:-1], 1):
                keys, n = np.unique(h[s.rows[:, k] != 0], return_counts=True)
                out += [(k, x, c) for x, c in zip(keys[n >= least].view(np.int64).tolist(), n[n >= least].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["k", "key", "n"])

    found = materialize(texts.sample(share, 7).mapInArrow(counted, "k int, key long, n long").groupBy("k", "key").agg(F.sum("n").alias("n")), "prefixes")
    total = found.where("k = 0").agg(F.sum("n")).first()[0] or 0
    most = [found.where((F.col("k") == k) & (F.col("n") * 4 * buckets > total)).orderBy(F.desc("n"), "key").limit(HOT).select("key").toArrow().column(0) for k in range(1, max_n)]
    return [np.sort(x.to_numpy().astype(np.int64).view(np.uint64)) for x in most]


def phrase_counts(docs: DataFrame, *, max_n: int = 4, floor: int = 30, text: str = "text", lang: str = "lang", bucket_bytes: int = 6 << 20, share: float | None = None, buckets: int | None = None, fan: int = FAN) -> DataFrame:
    """(lang, phrase, words, f): how often each phrase of 1 to max_n words stands within the pieces of texts of
    that language, for all that do so `floor` times or more; and with no words the number of all words.

    Texts are lower-cased in A-Z, cut into pieces at .,;:!? and line ends, and those into words at
    spaces and tabs. A null text is empty, a null language und; repeated rows count each time. A very
    long text is cut between pieces. An empty table gives no rows. Other columns play no part.
    """
    texts = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    size = input_bytes(texts) or texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = buckets or max(3 * partitions(docs), -(-size // bucket_bytes))
    hot = frequent_prefixes(texts, max_n, n, share if share is not None else min(1.0, max(1 / 256, n * 4096 / max(size, 1)))) if share != 0 else []
    rounds = 1
    while fan**rounds < n:
        rounds += 1

    def deal(batches):
        for s in _slices(batches, max_n, SLICE):
            yield s.merged().dealt(n, fan ** (rounds - 1), hot)

    def deal_again(left: int):
        def run(batches):
            held: dict[int, list[bytes]] = {}
            weight = 0
            for batch in batches:
                for bucket, load in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    held.setdefault(bucket, []).append(load)
                    weight += len(load)
                    if weight > 8 * SLICE:
                        yield from (Suffixes.of_loads(x).merged().dealt(n, fan**left, hot) for x in held.values())
                        held, weight = {}, 0
            yield from (Suffixes.of_loads(x).merged().dealt(n, fan**left, hot) for x in held.values())

        return run

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        depth, s = key[1].as_py(), Suffixes.of_loads(table.column("co_load").to_pylist()).merged()
        word = lambda i: s.said[s.ends[i - 1] - s.lengths[i - 1] : s.ends[i - 1]].decode()
        stack, closed = Stack(s.rows.shape[1]), []

        def take(frames) -> None:
            for c, (rows, counts) in enumerate(frames):
                keep = (rows[:, c] != 0) & ((counts >= floor) | (c < depth))
                closed.extend((tuple(r[: c + 1]), f) for r, f in zip(rows[keep].tolist(), counts[keep].tolist(), strict=True))

        for a in range(0, len(s.rows), 1 << 16):
            take(stack.push(s.rows[a : a + (1 << 16)], s.counts[a : a + (1 << 16)]))
        take(stack.close())
        give_back()
        found = [(word(r[0]), " ".join(map(word, r[1:])), len(r) - 1, f) for r, f in closed]
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
        return pa.table([pa.array(x, t) for x, t in zip(zip(*found, strict=True) if found else [()] * 4, kinds, strict=True)], ["lang", "phrase", "words", "f"])

    loads = texts.mapInArrow(deal, _LOADS)
    for left in range(rounds - 2, -1, -1):
        loads = loads.repartition("co_bucket").mapInArrow(deal_again(left), _LOADS)
    partial = loads.groupBy("co_bucket", "co_depth").applyInArrow(count, _PHRASES)
    return partial.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where((F.col("f") >= floor) | (F.col("words") == 0))


def collocations(docs: DataFrame, *, max_n: int = 4, floor: int = 30, inside: int = 80, first: int = 2000, text: str = "text", lang: str = "lang", **how) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the `first` phrases of 2 to max_n words
    with the highest scores, ties to the more frequent and then to the smaller in UTF-8.

    a, l and r are the counts of the phrase and of the two parts into which it is cut where
    floor(2,000,000 a / (l + r)) is least (ties: the shorter first part), n that of all words. A phrase
    goes that stands in a longer one (dropped or not) with 100 times the longer one's count at least
    `inside` times its own. All arithmetic is of whole numbers, products in 38 digits. Odd rows: see
    phrase_counts; `how` goes there too.
    """
    counts = materialize(phrase_counts(docs, max_n=max_n, floor=floor, text=text, lang=lang, **how), "phrases")
    part = lambda name: counts.where("words > 0").select("lang", F.col("phrase").alias(name), F.col("f").alias(name[0]))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    joined = lambda w, a, n: F.array_join(F.slice(w, a, n), " ")
    candidates = counts.where("words > 1").withColumnRenamed("f", "a")
    w = F.split("phrase", " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"left": joined(w, F.lit(1), F.col("k")), "right": joined(w, F.col("k") + 1, F.col("words") - F.col("k"))})
    scored = cuts.join(part("left"), ["lang", "left"]).join(part("right"), ["lang", "right"]).withColumn("scaled", F.lit(2_000_000).cast("decimal(10,0)") * wide("a")).withColumn("both", wide("l") + wide("r"))
    least = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr("scaled div both").alias("score"), "k", "l", "r")).alias("cut"))
    # Each run of two words or more that is shorter than the candidate, with the largest count of what holds it.
    sizes = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: joined(w, i, n))))
    held = candidates.where("words > 2").select("lang", F.explode(sizes).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = least.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.lit(100) * wide("longer") < F.lit(inside) * wide("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
