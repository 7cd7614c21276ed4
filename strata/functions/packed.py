"""Sets of numbers as a few bytes: what travels with many rows is packed, and is a list again where it has arrived."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Packed bytes that are unpacked at a time, if one row has no more.
_STEP = 4_000_000


def _written(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 on, seven bits in a byte, the lowest first, all but the last of a number marked; and where each begins."""
    sizes = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        sizes += values >= 1 << bits
    at = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for i in range(int(sizes.max(initial=0))):
        on = sizes > i
        out[at[on] + i] = (values[on] >> 7 * i & 127) | np.where(sizes[on] > i + 1, 128, 0)
    return out, at


def _read(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that were written, and where each ends."""
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    sizes = ends - starts + 1
    values = np.zeros(len(ends), np.int64)
    for i in range(int(sizes.max(initial=0))):
        on = sizes > i
        values[on] |= (data[starts[on] + i] & 127).astype(np.int64) << 7 * i
    return values, ends + 1


def _pack(lists: pa.ListArray, low: int) -> pa.Array:
    offsets = np.asarray(lists.offsets, np.int64)
    values = np.asarray(lists.values, np.int64)[offsets[0] : offsets[-1]]
    counts = np.diff(offsets)
    rows = np.repeat(np.arange(len(lists)), counts)
    values = values[np.lexsort((values, rows))]
    high = values >> low
    first = np.concatenate([[True], rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, bool)
    steps = np.where(first, high, high - np.concatenate([[0], high[:-1]])) if len(rows) else high
    parts = np.stack([steps, values & ((1 << low) - 1)], 1).ravel() if low else steps
    data, at = _written(parts)
    cut = np.concatenate([at, [len(data)]])[(offsets - offsets[0]) * (2 if low else 1)]
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(cut.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _union(packs: pa.ListArray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of each row's packs, each once and in order, and how many each row has."""
    flat = packs.flatten()
    # An array without rows may have no offsets.
    at = np.frombuffer(flat.buffers()[1], np.int32, len(flat) + 1, 4 * flat.offset) if len(flat) else np.zeros(1, np.int32)
    data, cuts = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], at - at[0]
    values, ends = _read(data)
    each = np.diff(np.searchsorted(ends, cuts, "right")) // (2 if low else 1)
    steps = values[::2] if low else values
    total = np.cumsum(steps)
    before = np.concatenate([[0], total])[np.cumsum(each) - each]
    high = total - np.repeat(before, each)
    in_row = np.diff(np.asarray(packs.offsets, np.int64))
    rows = np.repeat(np.repeat(np.arange(len(packs)), in_row), each)
    made, rows = _in_order(high, values[1::2] if low else np.zeros(len(high), np.int64), low, rows)
    new = np.ones(len(made), bool)
    new[1:] = (made[1:] != made[:-1]) | (rows[1:] != rows[:-1])
    return made[new], np.bincount(rows[new], minlength=len(packs))


def _in_order(high: np.ndarray, less: np.ndarray, low: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of high and low bits, by row and then in order; as one number each with their row, where that fits."""
    wide, deep = int(high.max(initial=0)).bit_length(), int(less.max(initial=0)).bit_length()
    if wide + deep + int(rows.max(initial=0)).bit_length() < 63:
        keys = np.sort(rows << wide + deep | high << deep | less)
        return (keys >> deep & (1 << wide) - 1) << low | keys & (1 << deep) - 1, keys >> wide + deep
    made = high << low | less
    order = np.lexsort((made, rows))
    return made[order], rows[order]


def packed(low: int = 0) -> Callable[[Column], Column]:
    """A list of numbers from 0 on as bytes: in order, by the steps of their bits above the `low` ones, which follow each."""
    return F.arrow_udf(lambda lists: _pack(lists, low), "binary")


def united(low: int = 0) -> Callable[[Column], Column]:
    """Lists of packed() as one array of all their numbers, each once and in order."""

    def unpack(packs: pa.Array) -> pa.Array:
        sizes = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(packs.flatten()), np.int64))])
        so_far = sizes[np.asarray(packs.offsets, np.int64) - packs.offsets[0].as_py()]
        found, counts, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        while at < len(packs):
            to = max(int(np.searchsorted(so_far, so_far[at] + _STEP, "right")) - 1, at + 1)
            values, n = _union(packs.slice(at, to - at), low)
            found.append(values), counts.append(n)
            at = to
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(found)))

    return F.arrow_udf(unpack, "array<bigint>")
