"""Vectorised splitting and hashing of many texts at once, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text handled in one go; a longer text is handled on its own.
CHUNK_BYTES = 1 << 19

_SEED = np.random.Generator(np.random.PCG64(20240229))
_BYTES = _SEED.integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = max(n, CHUNK_BYTES + 1)
        known = np.ones(size, dtype=np.uint64)
        done, factor = 1, base
        while done < size:  # known[i] = base ** i, doubling the filled part
            step = min(done, size - done)
            known[done : done + step] = known[:step] * np.uint64(factor)
            factor = factor * factor % 2**64
            done += step
        if size == CHUNK_BYTES + 1:
            _POWERS[base] = known
    return known[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int = 0) -> np.ndarray:
    """A 64-bit hash of each data[start:end] that depends on the bytes alone; `kind` 0 or 1 gives another one."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTES[kind][data] * _powers(_BASES[kind], n), out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _powers(pow(_BASES[kind], -1, 2**64), n + 1)[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_chunks(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about `chunk_bytes` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + chunk_bytes, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of characters other than white space; a run ends with its row."""
    gap = _SPACE[data]
    inside = ~gap
    begins = inside.copy()
    begins[1:] &= gap[:-1]
    finishes = inside.copy()
    finishes[:-1] &= gap[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    finishes[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and bounds per row (`bounds[i]:bounds[i + 1]`) of the words, A-Z lower-cased."""
    lower = LOWER[data]
    starts, ends, rows = words(lower, offsets)
    bounds = np.searchsorted(rows, np.arange(len(offsets)))
    return span_hashes(lower, starts, ends), bounds


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Per row, the sorted distinct hashes of its shingles of `size` words.

    A row with fewer words has one shingle, the whole sequence; without words none.
    """
    hashes, bounds = word_hashes(data, offsets)
    count = len(hashes)
    full = max(0, count - size + 1)
    shingles = np.zeros(full, dtype=np.uint64)
    for i in range(size):
        shingles += mix(hashes[i : i + full], 11 + i)
    shingles = mix(shingles, 7)
    found = []
    for i in range(len(offsets) - 1):
        low, high = int(bounds[i]), int(bounds[i + 1])
        if high - low >= size:
            part = np.sort(shingles[low : high - size + 1])
            keep = np.ones(len(part), dtype=bool)
            keep[1:] = part[1:] != part[:-1]
            found.append(part[keep])
        elif high > low:
            short = sum((mix(hashes[low + j : low + j + 1], 11 + j) for j in range(high - low)), np.zeros(1, np.uint64))
            found.append(mix(short, 1000 + high - low))
        else:
            found.append(np.zeros(0, dtype=np.uint64))
    return found
