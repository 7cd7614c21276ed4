"""Words and word runs of many texts at once, as 64-bit hashes in numpy.

Texts come as an Arrow string column; its bytes are read in place, in slices of about a megabyte,
so the working arrays stay small whatever the number or the length of the texts in a batch.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            made = []
            for b in (self.base, self.inverse):
                x = np.full(size, b, np.uint64)
                x[0] = 1
                made.append(np.cumprod(x, dtype=np.uint64))
            self.up, self.down = made
        return self.up, self.down


@functools.cache
def powers() -> tuple[Powers, Powers]:
    return Powers(_P), Powers(_Q)


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null counts as empty. No copy for a column in one piece."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.string())
    if array.null_count:
        array = pc.fill_null(array, "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1] if offsets is not None else np.zeros(1, np.int32)
    return at.astype(np.int64), np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def _slices(offsets: np.ndarray):
    """Ranges of texts of about SLICE_BYTES each, one text at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts in order, number of words of each text).

    Words are the maximal runs of bytes other than the space and 09 to 0D; in UTF-8 no other
    character has those bytes.
    """
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in _slices(offsets):
        a, b = int(offsets[i]), int(offsets[j])
        at = offsets[i : j + 1] - a
        if a == b:
            counts.append(np.zeros(j - i, np.int64))
            continue
        buf = data[a:b]
        inside = (buf != 32) & ((buf < 9) | (buf > 13))
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < b - a)]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = powers()[0](b - a)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(BYTE_VALUES[buf] * up[: b - a], dtype=np.uint64, out=total[1:])
        hashes.append(mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
        counts.append(np.diff(np.searchsorted(starts, at)))
    return np.concatenate(hashes), np.concatenate(counts).astype(np.int64)


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of hashes[i : i + width] for each i where that is whole, across texts too."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = powers()[1](n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], dtype=np.uint64, out=total[1:])
    return mix((total[width:] - total[:-width]) * down[: n - width + 1] + np.uint64(width))


def places(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions in the words of all texts where a run of width words lies in one text, its text)."""
    begins = np.cumsum(counts) - counts
    each = np.maximum(counts - width + 1, 0)
    text = np.repeat(np.arange(len(counts)), each)
    inner = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    return begins[text] + inner, text
