"""Language identification by a convolutional network over bytes, trained in numpy.

Filters of widths 2, 3 and 4 slide over the bytes of a window of fixed length; the greatest
response of each filter goes through a linear layer and a softmax. A filter's response is a sum of
one number for each (place, byte), so two neighbouring bytes are one lookup in a table of 65,536
rows. Every window of a text is evaluated; a text's probabilities are the mean over its windows,
by their bytes.

Training takes a bounded sample, `per_language` texts of each language chosen by a hash of the id
and `windows` windows of each, to the driver. Prediction is one scan without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm import words as W
from strata.llm.memory import give_back

WIDTHS = (2, 3, 4)
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def held_out(doc_id: str) -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


@dataclass
class Network:
    languages: list[str]
    filters: list[np.ndarray]  # for each width (width, 256, filters)
    weights: np.ndarray
    bias: np.ndarray
    window: int

    def tables(self) -> list[list[tuple[int, np.ndarray]]]:
        """For each width the (offset, table by two bytes) whose rows add up to the responses."""
        out = []
        for f in self.filters:
            pairs = []
            for j in range(0, len(f) - 1, 2):
                pairs.append((j, (f[j][:, None, :] + f[j + 1][None, :, :]).reshape(65536, -1)))
            if len(f) % 2:
                pairs.append((len(f) - 1, np.repeat(f[-1], 256, axis=0)))
            out.append(pairs)
        return out

    def probabilities(self, windows: np.ndarray, tables: list | None = None, step: int = 512) -> np.ndarray:
        tables, out = tables or self.tables(), []
        for a in range(0, len(windows), step):
            part = windows[a : a + step]
            wide = np.zeros((len(part), self.window + 4), np.int32)
            wide[:, : self.window] = part
            two = (wide[:, :-1] << 8) | wide[:, 1:]
            pooled = []
            for f, pairs in zip(self.filters, tables, strict=True):
                n = self.window - len(f) + 1
                response = None
                for j, table in pairs:
                    found = np.take(table, two[:, j : j + n], axis=0)
                    response = found if response is None else np.add(response, found, out=response)
                pooled.append(response.max(axis=1))
            z = np.maximum(np.concatenate(pooled, axis=1), 0) @ self.weights + self.bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out.append(z / z.sum(axis=1, keepdims=True))
        return np.concatenate(out) if out else np.zeros((0, len(self.bias)), np.float32)


def train(windows: np.ndarray, label: np.ndarray, languages: list[str], *, filters: int = 8, epochs: int = 8, batch: int = 64, rate: float = 0.02, seed: int = 0) -> Network:
    """Cross-entropy by Adam; the gradient of a pooled response goes to the bytes under its maximum."""
    rng, size = np.random.default_rng(seed), windows.shape[1]
    params = [rng.normal(0, 0.1, (w, 256, filters)).astype(np.float32) for w in WIDTHS]
    params += [rng.normal(0, 0.1, (filters * len(WIDTHS), len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    total = epochs * -(-len(windows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            x, y = windows[rows].astype(np.int64), label[rows]
            pooled, tops = [], []
            for f in params[:-2]:
                n = size - len(f) + 1
                r = f[0][x[:, :n]]
                for j in range(1, len(f)):
                    r = r + f[j][x[:, j : j + n]]
                top = r.argmax(axis=1)
                tops.append(top)
                pooled.append(np.take_along_axis(r, top[:, None, :], axis=1)[:, 0, :])
            h = np.concatenate(pooled, axis=1)
            active = np.maximum(h, 0)
            z = active @ params[-2] + params[-1]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            g = z / z.sum(axis=1, keepdims=True)
            g[np.arange(len(y)), y] -= 1
            g /= len(y)
            back = (g @ params[-2].T) * (h > 0)
            grads = []
            for k, (f, top) in enumerate(zip(params[:-2], tops, strict=True)):
                d = np.zeros_like(f)
                part = back[:, k * filters : (k + 1) * filters]
                for j in range(len(f)):
                    np.add.at(d[j], (np.take_along_axis(x, top + j, axis=1), np.arange(filters)[None, :]), part)
                grads.append(d)
            grads += [active.T @ g, g.sum(axis=0)]
            t += 1
            pace = rate * (1 - t / (total + 1))
            for p, d, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                p -= pace * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-6)
    return Network(languages, params[:-2], params[-2], params[-1], size)


def cut_windows(offsets: np.ndarray, data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, text of each, bytes of each): every text in windows of `size` bytes, the last one
    filled up with zeros; none for an empty text."""
    lengths = np.diff(offsets)
    n = -(-lengths // size)
    text = np.repeat(np.arange(len(n)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    used = np.minimum(lengths[text] - k * size, size)
    out = np.zeros(int(n.sum()) * size, np.uint8)
    at = np.repeat((np.cumsum(n) - n) * size, lengths) + (np.arange(int(lengths.sum())) - np.repeat(offsets[:-1] - offsets[0], lengths))
    out[at] = data[offsets[0] : offsets[-1]]
    return out.reshape(-1, size), text, used


def learn(docs: DataFrame, *, doc_id: str, text: str, lang: str, window: int, per_language: int, windows: int, seed: int = 0) -> Network | None:
    """The network fitted to a bounded sample of labelled rows outside the held-out third; None without any."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(doc_id) & F.col(doc_id).isNotNull())
    counts = {r[0]: r["count"] for r in labelled.groupBy(lang).count().collect()}
    if not counts:
        return None
    # 2^-63 of a hash is uniform in [0, 1); a margin over the wanted number, cut to it below.
    chance = F.lit(0.0)
    for name, n in counts.items():
        chance = F.when(F.col(lang) == name, F.lit(min(1.0, 1.5 * per_language / n))).otherwise(chance)
    drawn = F.abs(F.xxhash64(F.lit(seed), F.col(doc_id)).cast("double")) / F.lit(2.0**63)
    width = F.greatest(F.length(text) - window, F.lit(1))
    parts = F.array(*[F.substring(F.col(text), (F.pmod(F.xxhash64(F.col(doc_id), F.lit(j)), width) + 1).cast("int"), F.lit(window)) for j in range(windows)])
    rows = labelled.where(drawn < chance).select(F.col(lang).alias("l"), drawn.alias("d"), parts.alias("p")).toArrow().sort_by([("d", "ascending")]).to_pylist()
    languages = sorted(counts)
    taken, pieces, label = dict.fromkeys(languages, 0), [], []
    for r in rows:
        if taken[r["l"]] < per_language:
            taken[r["l"]] += 1
            for p in dict.fromkeys(r["p"]):
                pieces.append(p.encode()[:window])
                label.append(languages.index(r["l"]))
    if not pieces:
        return None
    table = np.zeros((len(pieces), window), np.uint8)
    for i, p in enumerate(pieces):
        table[i, : len(p)] = np.frombuffer(p, np.uint8)
    return train(table, np.array(label), languages, seed=seed)


def identify(
    docs: DataFrame, *, labelled: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
    window: int = 256, per_language: int = 500, windows: int = 4, untrained: str | None = "und",
) -> DataFrame:
    """docs plus li_lang and li_score: the likeliest of the languages learned from `labelled` (docs
    themselves by default), and its probability.

    A text that is null or has no letter is `und` with score 0. If there is no row to learn from, every
    other text is `untrained`, with score 0. The prediction reads the text only, so repeated rows get equal
    ones; of languages with equal probabilities the first by name is said. A very long text is read window by
    window, all of it. An empty table gives no rows. Bounds of the sample: per_language texts of each
    language, `windows` windows of each. Columns of docs stay; one with a name of the result's is
    overwritten.
    """
    net = learn(labelled if labelled is not None else docs, doc_id=doc_id, text=text, lang=lang, window=window, per_language=per_language, windows=windows)
    kept = [c for c in docs.columns if c not in ("li_lang", "li_score")]
    source = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("li__text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("li_lang", T.StringType()), T.StructField("li_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else None
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                column = part.column(part.num_columns - 1)
                n, best, score = part.num_rows, np.full(part.num_rows, -1), np.zeros(part.num_rows)
                offsets, data = W.text_bytes(column)
                if net:
                    sums, weight = np.zeros((n, len(net.languages))), np.zeros(n)
                    for i, j in W._slices(offsets):
                        w, owner, used = cut_windows(offsets[i : j + 1], data, net.window)
                        p = net.probabilities(w, tables)
                        np.add.at(sums, owner + i, p * used[:, None])
                        np.add.at(weight, owner + i, used)
                for k in range(n):
                    raw = data[offsets[k] : offsets[k + 1]].tobytes()
                    if raw and (_ASCII_LETTER.search(raw) or any(map(str.isalpha, raw.decode()))):
                        best[k] = int(sums[k].argmax()) if net else 0
                        score[k] = min(1.0, sums[k, best[k]] / weight[k]) if net else 0.0
                languages = net.languages if net else [untrained]
                names = pa.array([languages[b] if b >= 0 else "und" for b in best], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(part.num_columns - 1)] + [names, pa.array(score)], [*kept, "li_lang", "li_score"])
        give_back()

    return source.mapInArrow(run, schema)
