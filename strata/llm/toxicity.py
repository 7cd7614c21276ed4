"""Toxicity by non-negative positive-unlabelled learning.

Known are texts confirmed as toxic, and many texts of which nothing is known. With the class prior
p the risk of a classifier is p times its loss on the positives taken as such, plus its loss on
the unlabelled texts taken as negatives, less p times that on the positives; the last two together
estimate the loss on the true negatives and are not let below zero. A linear model over the
presence of byte grams is fitted to it in numpy.

Grams are 5, 7 and 8 bytes of text in lower case whose ASCII punctuation and white space are
single spaces; a gram is kept exactly, as one 64-bit number. Those that set positives apart are
chosen once, from counts over a bounded sample; scoring is one scan that looks every gram of every
text up among the chosen ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm import words as W
from strata.llm.language import held_out
from strata.llm.memory import give_back
from strata.llm.store import materialize

GRAMS = (5, 7, 8)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
for _b in range(128):
    if not (48 <= _b < 58 or 97 <= _LOWER[_b] < 123):
        _LOWER[_b] = 32


def grams(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gram, text) for every place and length of every text, a text standing between spaces.

    The highest byte of a gram shorter than 8 is F0 and its length, which no UTF-8 text has there
    together with ASCII before it; 8 bytes stand for themselves.
    """
    lengths = np.diff(offsets)
    wide = lengths + 8
    begins = np.cumsum(wide) - wide
    buf = np.full(int(wide.sum()) + 8, 32, np.uint8)
    at = np.repeat(begins + 1, lengths) + (np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths))
    buf[at] = _LOWER[data[offsets[0] : offsets[-1]]]
    # Of a run of spaces one stays; the padding of a text is such a run.
    keep = (buf != 32) | np.r_[True, buf[:-1] != 32]
    keep[begins] = True
    owner = np.repeat(np.arange(len(lengths)), wide)
    buf, owner = buf[keep], owner[keep[: len(owner)]]
    buf = np.r_[buf, np.full(8, 32, np.uint8)]
    eight = np.ndarray((len(owner),), "<u8", buf, strides=(1,))
    values, owners = [], []
    for n in GRAMS:
        value = eight if n == 8 else (eight & np.uint64((1 << 8 * n) - 1)) | np.uint64((0xF0 + n) << 56)
        same = owner[: max(0, len(owner) - n + 1)] == owner[n - 1 :]
        values.append(value[: len(same)][same])
        owners.append(owner[: len(same)][same])
    return np.concatenate(values), np.concatenate(owners)


@dataclass
class Model:
    grams: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self._slot(self.grams)] = True

    @staticmethod
    def _slot(value: np.ndarray) -> np.ndarray:
        return ((value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def present(self, value: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, number of a chosen gram) for each chosen gram that a text has, once."""
        if not len(self.grams) or not len(value):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hit = self.seen[self._slot(value)]
        value, text = value[hit], text[hit]
        at = np.minimum(np.searchsorted(self.grams, value), len(self.grams) - 1)
        found = self.grams[at] == value
        pairs = np.unique(text[found].astype(np.int64) * len(self.grams) + at[found])
        return pairs // len(self.grams), pairs % len(self.grams)

    def scores(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        out = np.full(len(offsets) - 1, self.bias)
        for i, j in W._slices(offsets):
            text, gram = self.present(*grams(offsets[i : j + 1], data))
            np.add.at(out, text + i, self.weights[gram])
        return 1.0 / (1.0 + np.exp(-np.clip(out, -30, 30)))


def fit(text: np.ndarray, gram: np.ndarray, positive: np.ndarray, n_grams: int, prior: float, *, epochs: int = 400, rate: float = 0.05, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with the logistic loss, by Adam over
    whole passes. Where the estimated loss on negatives is below zero, the step undoes it."""
    w, b = np.zeros(n_grams), 0.0
    m, v = np.zeros(n_grams + 1), np.zeros(n_grams + 1)
    np_, nu = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    sigmoid = lambda z: 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, epochs + 1):
        z = b + np.bincount(text, w[gram], len(positive))
        s = sigmoid(z)
        # Losses: log(1 + e^-z) as positive, log(1 + e^z) as negative; derivatives s - 1 and s.
        as_negative = np.logaddexp(0, z)
        negatives = as_negative[~positive].sum() / nu - prior * as_negative[positive].sum() / np_
        d_negative = np.where(positive, -prior * s / np_, s / nu)
        d = d_negative + np.where(positive, prior * (s - 1) / np_, 0.0) if negatives >= 0 else -d_negative
        g = np.r_[np.bincount(gram, d[text], n_grams) + decay * w, d.sum()]
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def learn(docs: DataFrame, labels: DataFrame, *, doc_id: str, text: str, positives: int, unlabelled: int, chosen: int, seed: int = 0) -> Model | None:
    known = labels.where(F.col("toxic").isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id)).select(F.col(doc_id).alias("id"), "toxic")
    n, n_toxic = known.agg(F.count("*"), F.count_if(F.col("toxic") == 1)).first()
    n_docs = docs.count()
    if not n_toxic or not n_docs:
        return None
    prior = min(0.9, max(1e-4, n_toxic / n))
    drawn = lambda c, salt: F.abs(F.xxhash64(F.lit(seed + salt), c).cast("double")) / F.lit(2.0**63)
    # At most about `positives` ids, so they may be broadcast.
    ids = known.where("toxic = 1").where(drawn(F.col("id"), 1) < min(1.0, positives / n_toxic)).select("id").distinct()
    d = docs.where(~held_out(doc_id) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    pos = d.join(F.broadcast(ids), "id", "left_semi").select("text", F.lit(True).alias("positive"))
    unl = d.where(drawn(F.col("id"), 2) < min(1.0, 1.5 * unlabelled / n_docs)).select("text", F.lit(False).alias("positive"))
    sample = materialize(pos.unionByName(unl).repartition(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "tox-sample")
    n_pos, n_unl = sample.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                value, owner = grams(*W.text_bytes(part.column(0)))
                order = np.lexsort((owner, value))
                value, owner = value[order], owner[order]
                new = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])] if len(value) else np.zeros(0, bool)
                value, is_pos = value[new], part.column(1).to_numpy(zero_copy_only=False)[owner[new]]
                first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]]) if len(value) else np.zeros(0, np.int64)
                both = np.diff(np.r_[first, len(value)])
                p = np.add.reduceat(is_pos.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(value[first].astype(np.int64)), pa.array(p), pa.array(both - p)], ["gram", "p", "u"])

    # The more positives, the more grams there are to stand out by chance; beyond the bar, chance is rare.
    bar = min(8.0, 4.0 + float(np.log(max(1, n_pos))))
    fp = F.sum("p") / F.lit(float(max(1, n_pos)))
    fu = F.sum("u") / F.lit(float(max(1, n_unl)))
    # How far the positives that have a gram exceed what unlabelled texts let expect, as a log
    # likelihood ratio of Poisson counts; the expected are those of at least half an unlabelled text.
    expected = F.lit(float(n_pos)) * F.greatest(fu, F.lit(0.5 / max(1, n_unl)))
    gain = F.sum("p") * F.log(F.sum("p") / expected) - (F.sum("p") - expected)
    stats = sample.mapInArrow(count, "gram long, p long, u long").groupBy("gram").agg(F.sum("p").alias("n"), gain.alias("gain"), (fp / F.greatest(fu, F.lit(1e-9))).alias("lift"))
    best = stats.where((F.col("n") >= 3) & (F.col("gain") >= bar) & (F.col("lift") >= 3.0)).orderBy(F.desc("gain"), "gram").limit(chosen)
    table = np.sort(best.select("gram").toArrow().column(0).to_numpy().astype(np.uint64))
    if not len(table):
        return None
    blank = Model(table, np.zeros(len(table)), 0.0)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                owner, gram = blank.present(*grams(*W.text_bytes(part.column(0))))
                cut = np.searchsorted(owner, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([part.column(1), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(gram.astype(np.int32)))], ["positive", "grams"])

    rows = sample.mapInArrow(mark, "positive boolean, grams array<int>").toArrow()
    lists = rows.column("grams").combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    owner, gram, positive = np.repeat(np.arange(len(lists)), lengths), lists.flatten().to_numpy(), rows.column("positive").to_numpy(zero_copy_only=False)
    weights, bias = fit(owner, gram, positive, len(table), prior)
    z = bias + np.bincount(owner, weights[gram], len(positive))
    return Model(table, weights, bias + shift(z[~positive], bias, prior))


def shift(z: np.ndarray, bias: float, prior: float, at: float = 0.7) -> float:
    """What to add so that scores pass `at` about where the class prior puts the line among the
    unlabelled: halfway between the quantiles that leave 0.95 and 1.1 times the prior above them,
    and above the texts without any chosen gram, whose z is the bias."""
    above = z[z > bias + 1e-6]
    if not len(above):
        return 0.0
    line = float(np.quantile(z, [1 - 0.95 * prior, max(0.0, 1 - 1.1 * prior)]).mean())
    return float(np.log(at / (1 - at)) - max(line, bias + 0.5 * (float(np.quantile(above, 0.1)) - bias)))


def toxicity(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
    positives: int = 3000, unlabelled: int = 12000, chosen: int = 4096,
) -> DataFrame:
    """docs plus tox_score, from 0 to 1 and higher for likelier toxic texts.

    Learned from labels (doc_id, toxic) outside the held-out third: of them only who is toxic and
    the share that is. Bounds of the sample: about `positives` toxic and 1.5 * `unlabelled` other
    texts, `chosen` grams. A null text counts as empty. A gram is chosen if three toxic texts have it
    and it stands out from the unlabelled: without such a gram (fewer than three toxic texts, or toxic
    texts with nothing in common) there is nothing to learn and all scores are 0. Of a hundred toxic
    texts or fewer, what marks only a few of them is not learned. Texts with the same grams have the
    same score; rows with equal ids are scored each by its text, a label counts for all of them.
    An empty table gives no rows. The score reads the text only. Columns of docs stay; one named
    tox_score is overwritten.
    """
    model = learn(docs, labels, doc_id=doc_id, text=text, positives=positives, unlabelled=unlabelled, chosen=chosen)
    kept = [c for c in docs.columns if c != "tox_score"]
    source = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("tox__text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("tox_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n = part.num_columns - 1
                score = model.scores(*W.text_bytes(part.column(n))) if model else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(n)], pa.array(score)], [*kept, "tox_score"])
        give_back()

    return source.mapInArrow(run, schema)
