"""Ranked lexical search in norm buckets.

Each document is the vector of its impacts on the terms that any item of a block
asks for, each item the vector of its weights. Vectors are ordered by length and cut
into buckets. A bucket is left out for an item if its longest vector times the
item's length stays below the score that the item's best documents have already
(Cauchy-Schwarz). Within a bucket, the coordinates of the item's heaviest terms
bound what a vector can still score. The rest is scored exactly in integers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rxcover.llm.runs import binaries, byte_table, joined, word_runs
from rxcover.llm.shared import stored
from rxcover.llm.textvec import LOWER, span_hashes, text_chunks

# Fixed values of the contract: what is no part of a term, and the constants of the score.
BETWEEN_TERMS = byte_table([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
WEIGHT_UNIT, IMPACT_UNIT, TF_UNIT, K1, B = 1000, 1_000_000_000, 1000, 12, 25
BEST = 20
# Items that are searched in one pass over the documents.
BLOCK_ITEMS = 1000
# Vectors of one bucket.
BUCKET = 2048
# Coordinates that are looked at before a vector is scored.
FOCUS = 4
# Every so manieth vector is scored first, only to know a score that the best ones reach.
SEED_SHARE = 16
# Room for rounding in bounds; scores are integers.
SLACK = 1 + 1e-9

_VECTORS = "doc_id long, n long, terms binary, counts binary"
_IMPACTS = "doc_id long, norm double, terms binary, impacts binary"
_FOUND = "item int, doc_id long, score long"


@dataclass
class Vocabulary:
    """Terms by two independent 64-bit hashes, ordered by the first."""

    first: np.ndarray
    second: np.ndarray

    def places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the spans that are terms: which span, and which term."""
        if not len(self.first):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = span_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.first, hashes), len(self.first) - 1)
        which = np.flatnonzero(self.first[at] == hashes)
        same = self.second[at[which]] == span_hashes(data, starts[which], ends[which], kind=1)
        return which[same], at[which][same]


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per item and distinct term."""
    for batch in batches:
        item = batch.column("item").to_numpy()
        for first, data, offsets in text_chunks(batch.column("text")):
            low = LOWER[data]
            starts, ends, rows = word_runs(low, offsets, BETWEEN_TERMS)
            hashes = [span_hashes(low, starts, ends, kind).view(np.int64) for kind in (0, 1)]
            distinct, counts = np.unique(np.stack([rows, *hashes], axis=1), axis=0, return_counts=True)
            columns = [item[first + distinct[:, 0]], distinct[:, 1], distinct[:, 2], counts.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["item", "first", "second", "times"])


def _vectorised(terms: Vocabulary) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, len(terms.first))
        for batch in batches:
            for first, data, offsets in text_chunks(batch.column("text")):
                low, n = LOWER[data], len(offsets) - 1
                starts, ends, rows = word_runs(low, offsets, BETWEEN_TERMS)
                which, term = terms.places(low, starts, ends)
                keys, counts = np.unique(rows[which] * size + term, return_counts=True)
                bounds = np.searchsorted(keys, np.arange(n + 1) * size)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, n),
                        pa.array(np.bincount(rows, minlength=n).astype(np.int64)),
                        binaries((keys % size).astype(np.int32), bounds),
                        binaries(counts.astype(np.int32), bounds),
                    ],
                    ["doc_id", "n", "terms", "counts"],
                )

    return run


def _document_counts(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents that hold each term, summed within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += np.bincount(joined(batch.column("terms"), np.int32)[0], minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["term", "df"])

    return run


def _weighed(weights: np.ndarray, documents: int, all_terms: int):
    """Impacts and length of every vector with any term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, bounds = joined(batch.column("terms"), np.int32)
            counts, _ = joined(batch.column("counts"), np.int32)
            # Python integers: n times the number of documents may pass 64 bits.
            scale = [100 - B + (B * n * documents) // all_terms if n else 100 - B for n in batch.column("n").to_pylist()]
            m = np.repeat(np.array(scale, dtype=np.int64), np.diff(bounds))
            tf = counts.astype(np.int64)
            impacts = (IMPACT_UNIT * tf) // (TF_UNIT * tf + K1 * m)
            rows = np.repeat(np.arange(len(batch)), np.diff(bounds))
            squares = weights[terms] * impacts.astype(np.float64) ** 2
            norms = np.sqrt(np.bincount(rows, weights=squares, minlength=len(batch)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(norms),
                    batch.column("terms"),
                    binaries(impacts.astype(np.int32), bounds),
                ],
                ["doc_id", "norm", "terms", "impacts"],
            )

    return run


@dataclass
class Item:
    """Terms of one item, heaviest first, with their weights times their number."""

    terms: np.ndarray
    weights: np.ndarray
    direction: np.ndarray
    length: float


class Bucket:
    """Vectors of similar length, by term."""

    def __init__(self, doc_ids: pa.Array, norms: np.ndarray, terms: np.ndarray, impacts: np.ndarray, bounds: np.ndarray, size: int):
        self.doc_ids, self.norms = doc_ids, norms
        order = np.argsort(terms, kind="stable")
        self.docs = np.repeat(np.arange(len(norms)), np.diff(bounds))[order]
        self.impacts = impacts[order].astype(np.int64)
        self.ends = np.searchsorted(terms[order], np.arange(size + 1))

    def of(self, term: int) -> slice:
        return slice(self.ends[term], self.ends[term + 1])

    def candidates(self, item: Item, root: np.ndarray, least: int) -> np.ndarray | None:
        """Vectors that may score `least` or more; None stands for no bound."""
        if least <= 0:
            return None
        possible = item.length * self.norms * SLACK >= least
        cosine = min(1.0, least / (item.length * self.norms[0] * SLACK))
        for term, share in zip(item.terms[:FOCUS], item.direction[:FOCUS]):
            spread = math.sqrt(max(0.0, (1 - cosine * cosine) * (1 - share * share))) + 1e-6
            # A vector along the term itself is near enough to the item if the term's share is.
            low, high = share * cosine - spread, math.inf if share >= cosine else share * cosine + spread
            part = np.zeros(len(self.norms))
            at = self.of(term)
            part[self.docs[at]] = self.impacts[at] * root[term] / self.norms[self.docs[at]]
            possible &= (part >= low) & (part <= high)
        return possible

    def scores(self, item: Item, possible: np.ndarray | None) -> np.ndarray:
        total = np.zeros(len(self.norms), dtype=np.int64)
        for term, weight in zip(item.terms, item.weights):
            at = self.of(term)
            docs, impacts = self.docs[at], self.impacts[at]  # a vector has a term once
            if possible is not None:
                kept = possible[docs]
                docs, impacts = docs[kept], impacts[kept]
            total[docs] += weight * impacts
        return total


def _best(scores: np.ndarray, ids: np.ndarray, none: np.ndarray, best: int) -> np.ndarray:
    """Places of the best: highest score, then smallest id, rows without an id last."""
    return np.lexsort((ids, none, -scores))[:best]


def _searched(items: list[Item], root: np.ndarray, reached: list[int], best: int, bucket: int):
    """The best documents of every item among the vectors of a task, which come longest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.zeros(0, dtype=np.int64)
        held = [(empty, empty, empty.astype(bool)) for _ in items]
        least = list(reached)
        for batch in _rows_of(batches, bucket):
            terms, bounds = joined(batch.column("terms"), np.int32)
            impacts, _ = joined(batch.column("impacts"), np.int32)
            norms = batch.column("norm").to_numpy()
            one = Bucket(batch.column("doc_id"), norms, terms, impacts, bounds, len(root))
            none = np.asarray(one.doc_ids.is_null())
            ids = one.doc_ids.fill_null(0).to_numpy()
            for i, item in enumerate(items):
                if item.length * norms[0] * SLACK < least[i]:
                    continue
                possible = one.candidates(item, root, least[i])
                if possible is not None and not possible.any():
                    continue
                scores = one.scores(item, possible)
                found = np.flatnonzero(scores >= max(1, least[i]))
                if len(found):
                    joint = [np.concatenate(x) for x in zip(held[i], (scores[found], ids[found], none[found]))]
                    kept = _best(*joint, best)
                    held[i] = tuple(x[kept] for x in joint)
                    if len(kept) == best:
                        least[i] = max(least[i], int(held[i][0][-1]))
        for i, (scores, ids, none) in enumerate(held):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(scores), i, dtype=np.int32)), pa.array(ids, mask=none), pa.array(scores)],
                ["item", "doc_id", "score"],
            )

    return run


def _rows_of(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of `rows`."""
    kept, count = [], 0
    for batch in batches:
        while count + len(batch) >= rows:
            take = rows - count
            yield pa.Table.from_batches([*kept, batch.slice(0, take)]).combine_chunks().to_batches()[0]
            batch, kept, count = batch.slice(take), [], 0
        if len(batch):
            kept.append(batch)
            count += len(batch)
    if count:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]


def ranked(
    docs: DataFrame,
    items: DataFrame,
    best: int = BEST,
    block_items: int = BLOCK_ITEMS,
    bucket: int = BUCKET,
) -> DataFrame:
    """`item_id`, `rank`, `doc_id`, `score`: the `best` documents of every item with a score above 0.

    Equal scores go by ascending `doc_id`, rows without one last. Repeated rows
    are documents, or items, of their own; each row of an item that is repeated
    has its own ranks. Null texts and texts without terms score nothing and count
    as no document. Terms are compared by 128 bits of hash. Other columns are
    ignored. An empty table on either side gives no rows.

    Items are searched in blocks of about `block_items`; a block's distinct terms
    go to every task, and the documents are read once a block. Vectors are spread
    by ranges of length, equal ones by chance, so copies do not meet in one task.
    A task holds one bucket and the best documents so far; it returns at most
    `best` rows an item, of which again only the best of each task are shuffled.
    """
    numbered = stored(
        items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "items"
    )
    asked = stored(numbered.select("item", "text").mapInArrow(_term_rows, "item long, first long, second long, times long"), "asked")
    blocks = max(1, -(-numbered.count() // block_items))
    found = None
    for block in range(blocks):
        one = _search_block(docs, asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block), best, bucket)
        found = one if found is None else found.unionByName(one)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    placed = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    return placed.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _search_block(docs: DataFrame, asked: DataFrame, best: int, bucket: int) -> DataFrame:
    """`item`, `doc_id`, `score` of the best documents of the block's items within each task."""
    rows = asked.toPandas()  # distinct terms of the block's items
    first, second = (rows[c].to_numpy(dtype=np.int64).view(np.uint64) for c in ("first", "second"))
    pairs = np.unique(np.stack([first, second], axis=1), axis=0) if len(rows) else np.zeros((0, 2), np.uint64)
    terms = Vocabulary(np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]))
    vectors = stored(docs.select("doc_id", "text").mapInArrow(_vectorised(terms), _VECTORS), "vectors")
    documents, all_terms = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = vectors.select("terms").mapInArrow(_document_counts(len(pairs)), "term long, df long")
    df = np.zeros(len(pairs), dtype=np.int64)
    for row in holding.groupBy("term").agg(F.sum("df").alias("df")).collect():  # terms of the block
        df[row["term"]] = row["df"]
    weights = np.array(
        [math.floor(WEIGHT_UNIT * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64
    )
    root = np.sqrt(weights.astype(np.float64))
    numbers, items = [], []
    for number, own in rows.assign(term=_term_numbers(pairs, first, second)).groupby("item"):
        term, times = own["term"].to_numpy(), own["times"].to_numpy(dtype=np.int64)
        used = (df[term] > 0) & (weights[term] > 0)
        term, times = term[used], times[used]
        heavy = np.argsort(-times * root[term], kind="stable")
        term, times = term[heavy], times[heavy]
        length = float(np.sqrt(np.sum((times * root[term]) ** 2)))
        numbers.append(int(number))
        items.append(Item(term, times * weights[term], times * root[term] / (length or 1.0), length))

    impacts = vectors.mapInArrow(_weighed(weights, documents, all_terms), _IMPACTS).filter(F.octet_length("terms") > 0)
    impacts = stored(impacts.withColumn("chance", F.xxhash64(F.monotonically_increasing_id())), "impacts")

    def search(some: DataFrame, reached: list[int]) -> DataFrame:
        return some.select("doc_id", "norm", "terms", "impacts").mapInArrow(
            _searched(items, root, reached, best, bucket), _FOUND
        )

    seeds = search(impacts.filter(F.pmod("chance", F.lit(SEED_SHARE)) == 0), [0] * len(items))
    nth = Window.partitionBy("item").orderBy(F.desc("score"))
    seeds = seeds.withColumn("rank", F.row_number().over(nth)).filter(F.col("rank") == best)
    reached = [0] * len(items)
    for row in seeds.select("item", "score").collect():  # one row an item
        reached[row["item"]] = row["score"]
    ordered = impacts.repartitionByRange(F.desc("norm"), "chance").sortWithinPartitions(F.desc("norm"))
    found = search(ordered, reached)
    number = F.array(*[F.lit(x).cast("long") for x in numbers]) if numbers else F.array(F.lit(0).cast("long"))
    return found.select(F.get(number, F.col("item")).alias("item"), "doc_id", "score")


def _term_numbers(pairs: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Place of each (first, second) among the sorted distinct pairs."""
    if not len(pairs):
        return np.zeros(0, dtype=np.int64)
    _, number = np.unique(np.stack([first, second], axis=1), axis=0, return_inverse=True)
    return number.reshape(-1)
