"""Runs of word bytes in many texts at once, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa


def byte_table(values: Iterable[int]) -> np.ndarray:
    """True for the given bytes."""
    found = np.zeros(256, dtype=bool)
    found[list(values)] = True
    return found


def word_runs(data: np.ndarray, offsets: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every longest run without a byte of `between`; a run ends with its row."""
    gap = between[data]
    inside = ~gap
    begins, finishes = inside.copy(), inside.copy()
    begins[1:] &= gap[:-1]
    finishes[:-1] &= gap[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    finishes[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Bytes of values[bounds[i]:bounds[i + 1]] for each i."""
    body = pa.py_buffer(np.ascontiguousarray(values))
    offsets = pa.py_buffer((bounds * values.itemsize).astype(np.int64))
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, offsets, body]).cast(pa.binary())


def joined(column: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of `binaries`, and the bounds of each row."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    size = np.dtype(dtype).itemsize
    if body is None or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=dtype), np.zeros(len(column) + 1, dtype=np.int64)
    values = np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]].copy().view(dtype)
    return values, (offsets - offsets[0]) // size
