"""Hashed terms of whole texts: words, beginnings of words, and the shape of tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxcover.llm.textvec import LOWER, mix, span_hashes, text_chunks, words

# Bytes from which a word's beginnings are terms of their own.
BEGINNINGS = (4, 5, 6, 7, 8)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True

# Classes of bytes in a token's shape: lower, upper, digit, part of another letter, and each mark as itself.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 97, 65, 48, 97


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z, and the capitals of Latin-1 in UTF-8, in lower case."""
    low = LOWER[data]
    if len(data) > 1:
        second = low[1:]
        capital = (low[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
        second[capital] += 0x20
    return low


def letter_runs(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of letters (any byte beyond ASCII counts as one)."""
    inside = _LETTER[low]
    begins, finishes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    finishes[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(low))]
    begins[edges] = inside[edges]
    finishes[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each word and of its beginnings."""
    low = lowered(data)
    starts, ends, rows = letter_runs(low, offsets)
    found, where = [span_hashes(low, starts, ends)], [rows]
    for n in BEGINNINGS:
        longer = ends - starts > n
        found.append(mix(span_hashes(low, starts[longer], starts[longer] + n), 40 + n))
        where.append(rows[longer])
    return np.concatenate(where), np.concatenate(found)


def style_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of what a text looks like: per token its word, its shape, the shapes of it and the next
    token, and whether it repeats the token before it or one of the last few."""
    low = lowered(data)
    starts, ends, rows = words(low, offsets)
    hashes = span_hashes(low, starts, ends)
    shape = _CLASS[data]
    # Runs of one class count as one byte: the shape keeps the first of each run.
    change = np.ones(len(shape), dtype=bool)
    change[1:] = shape[1:] != shape[:-1]
    change[starts] = True
    slots = np.cumsum(change) - 1
    short = shape[change]
    ends_short = slots[ends - 1] + 1 if len(ends) else ends
    shapes = span_hashes(short, slots[starts], ends_short) if len(starts) else hashes
    near = rows[1:] == rows[:-1]
    found = [mix(hashes, 61), mix(shapes, 62), mix(shapes[1:] + mix(shapes[:-1], 63), 64)[near]]
    where = [rows, rows, rows[1:][near]]
    for step in (1, 2, 3):
        if len(rows) <= step:
            continue
        again = (rows[step:] == rows[:-step]) & (hashes[step:] == hashes[:-step])
        where.append(rows[step:][again])
        found.append(np.full(int(again.sum()), 1000 + step, dtype=np.uint64))
    length = np.minimum(ends - starts, 40).astype(np.uint64)
    where.append(rows)
    found.append(mix(length, 65))
    return np.concatenate(where), np.concatenate(found)


def counted(rows: np.ndarray, buckets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, bucket) in order, with counts; `size` buckets."""
    pairs, counts = np.unique(rows.astype(np.int64) * size + buckets, return_counts=True)
    return pairs // size, pairs % size, counts


def labelled_sample(labels: DataFrame, bound: int, classes: list[int]) -> DataFrame:
    """`doc_id`, `target`, `weight`: of each class at most `bound` rows, those of least id hash.

    `weight` is the number of rows of the class that each sampled row stands for.
    `labels` has `doc_id` and `target`; of repeated ids the largest target counts,
    and rows without id or target do not. The result has at most
    `bound * len(classes)` rows.
    """
    once = labels.filter("doc_id IS NOT NULL AND target IS NOT NULL").groupBy("doc_id").agg(
        F.max("target").cast("int").alias("target")
    )
    totals = once.groupBy("target").agg(F.count("*").alias("total"))
    picked = None
    for c in classes:
        part = once.filter(F.col("target") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
        picked = part if picked is None else picked.unionByName(part)
    size = picked.groupBy("target").agg(F.count("*").alias("taken"))
    shares = totals.join(F.broadcast(size), "target").selectExpr("target", "total / taken AS weight")
    return picked.join(F.broadcast(shares), "target").select("doc_id", "target", "weight")


def sampled_terms(docs: DataFrame, sample: DataFrame, terms, buckets: int) -> DataFrame:
    """`target`, `weight`, `terms` (distinct buckets), `counts` (of each), `total` for each sampled id.

    Of rows that share an id the least text is taken (null only if all are), so
    there are at most as many rows as `sample` has, however often an id occurs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in text_chunks(batch.column("text")):
                n = len(offsets) - 1
                rows, hashes = terms(data, offsets)
                row, bucket, counts = counted(rows, (hashes % np.uint64(buckets)).astype(np.int64), buckets)
                bounds = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
                total = np.bincount(row, weights=counts, minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("target").slice(first, n),
                        batch.column("weight").slice(first, n),
                        pa.ListArray.from_arrays(bounds, pa.array(bucket.astype(np.int32))),
                        pa.ListArray.from_arrays(bounds, pa.array(counts.astype(np.int32))),
                        pa.array(total.astype(np.int64)),
                    ],
                    ["target", "weight", "terms", "counts", "total"],
                )

    # The sample has a fixed bound, so it may be broadcast and the texts stay where they are.
    # Rows that share an id are combined before the shuffle, in which only sampled texts take part.
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id", "target", "weight").agg(F.min("text").alias("text"))
    return rows.mapInArrow(run, "target int, weight double, terms array<int>, counts array<int>, total long")


class Sparse:
    """Rows of (feature, value), for training on the bounded sample."""

    def __init__(self, lengths: np.ndarray, features: np.ndarray, values: np.ndarray):
        self.features, self.values, self.n = features, values, len(lengths)
        self.rows = np.repeat(np.arange(self.n), lengths)

    def dot(self, weights: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
        values = self.values if values is None else values
        return np.bincount(self.rows, weights=values * weights[self.features], minlength=self.n)

    def transposed(self, by_row: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.features, weights=self.values * by_row[self.rows], minlength=size)


class Adam:
    def __init__(self, rate: float):
        self.rate, self.steps, self.state = rate, 0, {}

    def step(self, **pairs: tuple[np.ndarray, np.ndarray]) -> None:
        """Move each (parameters, gradient) in place."""
        self.steps += 1
        for name, (value, slope) in pairs.items():
            m, v = self.state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
            m += 0.1 * (slope - m)
            v += 0.001 * (slope * slope - v)
            value -= self.rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)
