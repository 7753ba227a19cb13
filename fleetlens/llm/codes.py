"""Numpy helpers for tasks that walk whole texts: code points, word spans, hashes.

All functions work on one bounded slice of an Arrow batch. Hashes are 64 bits and depend on
the text alone, so they agree between tasks, runs and machines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_CHARS = 400_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits (public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_CHARS + 1), base, np.uint64)
        steps[0] = 1
        _POWERS[kind] = have = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def text_slices(batch: pa.RecordBatch, column: str, chars: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, code points of their texts end to end, where each text starts: n + 1 numbers).

    A slice holds as many rows as fit in ``chars``, one row at least; a null text is empty.
    """
    at = batch.schema.get_field_index(column)
    lengths = pc.fill_null(pc.utf8_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    row = 0
    while row < len(lengths):
        limit = (ends[row - 1] if row else 0) + chars
        stop = max(row + 1, int(np.searchsorted(ends, limit, "right")))
        part = batch.slice(row, stop - row)
        whole = "".join(t or "" for t in part.column(at).to_pylist())
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        yield part, points, np.concatenate([[0], np.cumsum(lengths[row:stop])])
        row = stop


def runs(mask: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches where ``mask`` holds; none crosses a bound."""
    if not len(mask):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.zeros(len(mask) + 1, bool)
    edge[bounds] = True
    before = np.concatenate([[False], mask[:-1]])
    after = np.concatenate([mask[1:], [False]])
    starts = np.flatnonzero(mask & (~before | edge[:-1]))
    ends = np.flatnonzero(mask & (~after | edge[1:])) + 1
    return starts, ends


def point_values(points: np.ndarray) -> np.ndarray:
    """What ``value_hash`` adds up for each code point."""
    return mix(points.astype(np.uint64) + np.uint64(1))


def value_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``point_values``, equal for equal content anywhere."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers("up", _BASE, len(values)), out=total[1:])
    whole = (total[ends] - total[starts]) * _powers("down", _INVERSE, len(values) + 1)[starts]
    return mix(whole + (ends - starts).astype(np.uint64))


def span_hash(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, equal for equal content anywhere."""
    return value_hash(point_values(points), starts, ends)


def rolling_hash(points: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every ``k`` neighbours of ``points``, from one running sum."""
    n = len(points)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(points.astype(np.uint64)) * _powers("up", _BASE, n), out=total[1:])
    return mix((total[k:] - total[:-k]) * _powers("down", _INVERSE, n + 1)[: n - k + 1])


def gram_hash(items: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` neighbours of ``items``: len(items) - n + 1 values, in order."""
    if len(items) < n:
        return np.empty(0, np.uint64)
    size = len(items) - n + 1
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(31) + items[k : k + size])
    return out


def doc_of(starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which text each position lies in."""
    return np.searchsorted(bounds, starts, "right") - 1
