"""Exact top-k inner products by multi-resolution segment statistics.

Vectors are turned to the principal axes of a sample, so that those with most energy come first, and
cut into segments there: at first one, then 4 times as many at each finer level, and last the leading
half, three quarters and seven eighths of the axes one by one with the rest in fours. With the
mean m and the deviation s of a segment of length n, the squared distance of two vectors is at
least the sum of n((m - m')^2 + (s - s')^2), so their inner product is at most the sum of
n(m m' + s s'): a short inner product of statistics. Levels go from coarse to fine, without those that
drop next to nothing of the sample; a pair whose bound is below what its query already has k times
is dropped, and exact integer products of the vectors as they were are computed for the survivors.

Queries are taken in blocks of at most about `block_bytes`; one block at a time is broadcast and
the table streams past it, so what is broadcast or held doesn't grow with the table. Each query
starts with a bar, the k-th score that it has in a bounded sample of the table, and no pair whose
bound is below its bar goes on. Each task returns its best k of every query, and a window keeps
the best k of those.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.store import folder, materialize

_SAFE = 1 << 20
#: Queries that are held against a batch of the table at once.
_STRIP = 2048
#: Where more than this share of a batch's pairs survives all levels (no bar yet, or so few vectors that all
#: belong to the result), their exact products are taken as one product of matrices.
DENSE = 0.5


def levels(dim: int) -> list[np.ndarray]:
    """Starts of the segments of each level: 1, 4, 16, ... segments of 4 components at least; then leading
    components one by one, and the rest in fours."""
    out, n = [], 1
    while dim and (n == 1 or dim // n >= 4):
        out.append(np.unique(np.linspace(0, dim, n + 1).astype(int)[:-1]))
        n *= 4
    for eighths in (4, 6, 7) if dim >= 8 else ():
        one = dim * eighths // 8
        out.append(np.r_[np.arange(one), np.arange(one, dim, 4)])
    return out


def statistics(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows whose inner products bound those of x's rows: sqrt(n) times means, then the deviations of segments
    of more than one component."""
    n = np.diff(np.r_[starts, x.shape[1]]).astype(np.float64)
    mean = np.add.reduceat(x, starts, axis=1) / n
    several = n > 1
    square = np.add.reduceat(x * x, starts, axis=1)[:, several]
    var = square / n[several] - mean[:, several] ** 2
    return np.concatenate([mean * np.sqrt(n), np.sqrt(np.maximum(var, 0.0) * n[several])], axis=1)


def axes(sample: np.ndarray) -> np.ndarray:
    """Principal axes of some vectors as columns, those with most energy first."""
    scale = max(1.0, float(np.abs(sample).max(initial=0)))
    return np.linalg.eigh((sample / scale).T @ (sample / scale))[1][:, ::-1].copy()


def useful(queries: np.ndarray, sample: np.ndarray, turn: np.ndarray, k: int, least: float = 0.1) -> tuple[list[np.ndarray], list[float]]:
    """(the levels that drop a tenth at least of the pairs of queries and sample that those before left, what share is
    left after each). All levels if the sample is too small to say."""
    every = levels(sample.shape[1])
    if len(sample) <= k or not len(queries):
        return every, []
    score = queries @ sample.T
    bar = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
    q, v = queries @ turn, sample @ turn
    alive, kept, shares = np.ones(score.shape, bool), [], []
    for starts in every:
        now = alive & (statistics(q, starts) @ statistics(v, starts).T >= bar)
        if now.sum() <= (1 - least) * alive.sum():
            alive = now
            kept.append(starts)
            shares.append(float(alive.mean()))
    return kept or every[-1:], shares


def quantized(column: pa.Array, scale: int) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """(rows that take part, {length: (their positions, floor(scale * component) as doubles)})."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    valid = np.asarray(column.is_valid())
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten() if not column.null_count else column.values.slice(column.offsets[0].as_py(), int(lengths.sum()))
    raw = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(column)), lengths)
    bad = np.zeros(len(column), bool)
    bad[owner[~np.isfinite(raw)]] = True
    valid &= ~bad
    begins = np.cumsum(lengths) - lengths
    out = {}
    for n in np.unique(lengths[valid]).tolist():
        at = np.flatnonzero(valid & (lengths == n))
        out[n] = (at, np.floor(scale * raw[begins[at][:, None] + np.arange(n)]))
    return valid, out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, as 64-bit integers; beyond 64 bits the nearest of them."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) <= _SAFE:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    limit = (1 << 63) - 1
    return np.array([max(-limit - 1, min(limit, sum(int(x) * int(y) for x, y in zip(p, q, strict=True)))) for p, q in zip(a, b, strict=True)], np.int64)


class Best:
    """The best k of each of some queries of one length, against batches of vectors of that length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, turn: np.ndarray | None = None, starts: list[np.ndarray] | None = None) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        self.turn = np.eye(vectors.shape[1]) if turn is None else turn
        self.starts = levels(vectors.shape[1]) if starts is None else starts
        turned = vectors @ self.turn
        self.stats = [statistics(turned, s) for s in self.starts]
        #: Pairs that were met, and that were left after each level.
        self.pairs, self.left = 0, [0] * len(self.starts)
        self.query, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(len(ids), -np.inf)
        self.largest = float(np.abs(vectors).max(initial=0))

    def bar(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Raises each query's bar to the k-th score that it has among these rows of the table."""
        if len(ids) <= self.k or not self.exact(vectors):
            return
        score = np.where(self.ids[:, None] == ids[None, :], -np.inf, self.vectors @ vectors.T)
        self.least = np.maximum(self.least, -np.partition(-score, self.k - 1, axis=1)[:, self.k - 1])

    def exact(self, vectors: np.ndarray) -> bool:
        """Whether sums of products of doubles are exact."""
        return self.largest * float(np.abs(vectors).max(initial=0)) * max(1, vectors.shape[1]) < 1 << 53

    def take(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        q, i, s = np.r_[self.query, query], np.r_[self.id, ids], np.r_[self.score, score]
        order = np.lexsort((i, -s.astype(np.float64) if np.abs(s).max(initial=0) < 1 << 53 else np.argsort(np.argsort(-s, kind="stable")), q))
        q, i, s = q[order], i[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.query, self.id, self.score = q[keep], i[keep], s[keep]
        full = rank == self.k - 1
        self.least[q[full]] = np.maximum(self.least[q[full]], s[full])

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        alive = self.ids[:, None] != ids[None, :]
        margin = 1e-9 * max(1.0, self.largest) * np.abs(vectors).max(initial=1.0) * vectors.shape[1] + 1e-6
        self.pairs += alive.size
        turned = vectors @ self.turn
        for at, (starts, mine) in enumerate(zip(self.starts, self.stats, strict=True)):
            theirs = statistics(turned, starts)
            if alive.mean() > 0.05:
                alive &= mine @ theirs.T + margin >= self.least[:, None]
            else:
                q, i = np.nonzero(alive)
                alive[q, i] = np.einsum("ij,ij->i", mine[q], theirs[i]) + margin >= self.least[q]
            self.left[at] += int(alive.sum())
        if alive.mean() > DENSE and self.exact(vectors):
            score = np.where(alive, self.vectors @ vectors.T, -np.inf)
            if len(ids) > self.k:
                alive &= score >= -np.partition(-score, self.k - 1, axis=1)[:, self.k - 1 : self.k]
            q, i = np.nonzero(alive & (score >= self.least[:, None]))
            for a in range(0, len(q), 1 << 20):
                x, y = q[a : a + (1 << 20)], i[a : a + (1 << 20)]
                self.take(x, ids[y], score[x, y].astype(np.int64))
            return
        q, i = np.nonzero(alive)
        for a in range(0, len(q), 1 << 17):
            x, y = q[a : a + (1 << 17)], i[a : a + (1 << 17)]
            self.take(x, ids[y], products(self.vectors[x], vectors[y]))


def top_k(
    vectors: DataFrame, queries: DataFrame, *, k: int = 10, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding",
    block_bytes: int = 32 << 20, sample: int = 4096,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries its k highest scores among vectors.

    Components become floor(scale * x); the score is their inner product. Ties go to the smaller
    id; a vector with the query's own id is no candidate. Vectors that are null, or hold a null or
    non-finite component, take no part, on either side, nor do rows with a null id; vectors are
    compared with those of the same length, empty ones with empty ones (score 0). Of rows of queries
    with the same id the least vector asks; repeated rows of vectors are candidates each. Scores
    beyond 64 bits are cut to them. An empty table gives no rows; other columns play no part.

    About `sample` vectors, drawn by a hash of the id, set the bars, the axes and the levels; the result
    doesn't depend on them.
    """
    spark = vectors.sparkSession
    plain = lambda df: df.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("v"))
    source = plain(vectors)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    asked = plain(queries).where(finite).groupBy("id").agg(F.min("v").alias("v"))
    loaded = F.sum(F.size("v") * 8 + 16)
    n_bytes = asked.agg(loaded).first()[0] or 0
    blocks = max(1, -(-n_bytes // block_bytes))
    if blocks > 1:
        asked = materialize(asked, "top-k-asked")
    n_rows = source.count()
    # No more than the wanted number of rows, whatever ids repeat.
    drawn = F.abs(F.xxhash64(F.lit(7), "id", F.xxhash64("v")).cast("double")) / F.lit(2.0**63)
    some = source.where(finite & (drawn < min(1.0, sample / max(1, n_rows)))).limit(2 * sample).toArrow()
    _, some_by = quantized(some.column("v"), scale) if some.num_rows else (None, {})
    some_ids = some.column("id").to_numpy() if some.num_rows else None
    sampled = {d: (some_ids[at], x) for d, (at, x) in some_by.items()}
    schema = "query_id long, vec_id long, score long"
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best_of(b: int):
        """(broadcast, ranked rows) of one block of queries."""
        block = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        ids = block.column("id").to_numpy()
        by_length = quantized(block.column("v"), scale)[1] if len(ids) else {}
        ways = {}
        for d, (_, x) in by_length.items():
            drawn_of = sampled[d][1] if d in sampled else np.zeros((0, d))
            turn = axes(drawn_of)
            ways[d] = (turn, useful(x[:256], drawn_of[:2048], turn, k)[0])
        shared = spark.sparkContext.broadcast(({d: (ids[at], x) for d, (at, x) in by_length.items()}, {d: sampled[d] for d in by_length if d in sampled}, ways))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted, bars, ways = shared.value
            best = {d: [Best(i[a : a + _STRIP], x[a : a + _STRIP], k, *ways[d]) for a in range(0, len(i), _STRIP)] for d, (i, x) in wanted.items()}
            for d, (i, x) in bars.items():
                for strip in best[d]:
                    for a in range(0, len(i), 2048):
                        strip.bar(i[a : a + 2048], x[a : a + 2048])
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    ids = part.column(0).to_numpy()
                    for d, (rows, x) in quantized(part.column(1), scale)[1].items():
                        for strip in best.get(d, ()):
                            strip.add(ids[rows], x)
            for x in itertools.chain.from_iterable(best.values()):
                yield pa.RecordBatch.from_arrays([pa.array(x.ids[x.query]), pa.array(x.id), pa.array(x.score)], ["query_id", "vec_id", "score"])

        ranked = source.mapInArrow(run, schema).withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
        return shared, ranked.select("query_id", "rank", "vec_id", "score")

    if blocks == 1:
        return best_of(0)[1]
    path = folder(spark, "top-k")
    for b in range(blocks):
        shared, ranked = best_of(b)
        ranked.write.mode("append").parquet(path)
        shared.destroy()
    return spark.read.schema(ranked.schema).parquet(path)
