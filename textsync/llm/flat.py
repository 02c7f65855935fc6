"""Texts of an Arrow batch as one run of bytes, and the word hashes that several operators share."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: ASCII white space, which parts words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
MIX1, MIX2, STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``limit`` bytes of ``column``; a longer cell makes a run of its own."""
    cells = batch.column(batch.schema.get_field_index(column))
    if not len(cells):
        return
    cost = np.cumsum(np.maximum(_widths(cells), 16))
    at = 0
    while at < len(cells):
        base = cost[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(cost, base + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


def _widths(cells: pa.Array) -> np.ndarray:
    wide = 4 if pa.types.is_list(cells.type) or pa.types.is_large_list(cells.type) else 1
    if wide == 1 and not (pa.types.is_string(cells.type) or pa.types.is_binary(cells.type)):
        cells = cells.cast(pa.large_binary() if pa.types.is_binary(cells.type) or pa.types.is_large_binary(cells.type) else pa.large_string())
    kind = np.int32 if pa.types.is_string(cells.type) or pa.types.is_binary(cells.type) or pa.types.is_list(cells.type) else np.int64
    offsets = np.frombuffer(cells.buffers()[1], kind)[cells.offset : cells.offset + len(cells) + 1]
    return np.diff(offsets).astype(np.int64) * wide


def flatten(cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other and the offsets of each; null is empty."""
    cells = cells.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(cells.buffers()[1], np.int64)[cells.offset : cells.offset + len(cells) + 1]
    data = np.frombuffer(cells.buffers()[2], np.uint8) if cells.buffers()[2] is not None and len(offsets) and offsets[-1] else np.zeros(0, np.uint8)
    base = int(offsets[0]) if len(offsets) else 0
    return data[base : int(offsets[-1]) if len(offsets) else 0], offsets - base


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = x + STEP
        x = (x ^ (x >> np.uint64(30))) * MIX1
        x = (x ^ (x >> np.uint64(27))) * MIX2
        return x ^ (x >> np.uint64(31))


#: One value for each byte, and the base of the rolling sums with its inverse modulo 2 ** 64.
VALUES = mixed(np.arange(1, 257, dtype=np.uint64))
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        out = np.full(n, np.uint64(base))
        out[:1] = 1
        with np.errstate(over="ignore"):
            return np.multiply.accumulate(out)

    return run(BASE), run(INVERSE)


class Spans:
    """64-bit hashes of any spans of one run of bytes, from one pass of running sums."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _powers(1 << max(20, int(max(len(data), 1)).bit_length()))
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(VALUES[data] * power[: len(data)], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word; words never cross documents. ``space`` marks the bytes that part words."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge))
    end = np.flatnonzero(before & (~inside | edge))
    return start, end, np.searchsorted(offsets, start, "right") - 1


def windows(words: np.ndarray, first: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words inside one document, and the place of each run's first word.

    ``first`` and ``count`` give the words of each document."""
    n = len(words)
    room = np.zeros(n + 1, np.int64)
    np.add.at(room, first, np.where(count >= k, 1, 0))
    np.add.at(room, first + np.maximum(count - k + 1, 0), np.where(count >= k, -1, 0))
    at = np.flatnonzero(np.cumsum(room)[:n] > 0)
    with np.errstate(over="ignore"):
        out = words[at]
        for j in range(1, k):
            out = mixed(out * STEP + words[at + j])
    return out, at
