"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from rxcover.llm.shared import stored
from rxcover.llm.terms import Adam, Sparse, counted, labelled_sample, sampled_terms, word_terms
from rxcover.llm.texts import with_text_columns

BUCKETS = 1 << 20
# Labelled rows of each class that training uses at most.
SAMPLE_PER_CLASS = 10_000
# Terms of the model at most: those that tell most about the label in the sample.
FEATURES = 512
MIN_ROWS = 3
# G statistic that a term must reach; noise seldom does.
MIN_G = 12.0
RANK = 8
EPOCHS = 200


@dataclass
class FactorizationMachine:
    """score = sigmoid(bias + sum of w_i + sum over pairs of <v_i, v_j>), over the distinct terms of a text."""

    index: np.ndarray  # of each bucket its feature, or -1
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def scores(self, rows: np.ndarray, buckets: np.ndarray, count: int) -> np.ndarray:
        feature = self.index[buckets]
        known = feature >= 0
        row, feature, _ = counted(rows[known], feature[known], max(1, len(self.linear)))
        margin = self.bias + np.bincount(row, weights=self.linear[feature], minlength=count)
        for v in self.factors.T:
            total = np.bincount(row, weights=v[feature], minlength=count)
            margin += (total * total - np.bincount(row, weights=v[feature] ** 2, minlength=count)) / 2
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _telling(sampled: DataFrame, features: int, min_rows: int) -> list[int]:
    """Buckets whose presence differs most between the classes (G statistic), at most `features`."""
    classes = sampled.groupBy().agg(
        F.sum(F.col("weight") * F.col("target")).alias("pos"), F.sum(F.col("weight") * (1 - F.col("target"))).alias("neg")
    )
    terms = sampled.select("target", "weight", F.explode("terms").alias("term"))
    seen = terms.groupBy("term").agg(
        F.count("*").alias("rows"),
        F.sum(F.col("weight") * F.col("target")).alias("a"),
        F.sum(F.col("weight") * (1 - F.col("target"))).alias("b"),
    )
    # `classes` is one row.
    table = seen.filter(F.col("rows") >= min_rows).join(F.broadcast(classes))
    cell = "CASE WHEN {x} > 0 THEN {x} * ln({x} * (pos + neg) / ({row} * {col})) ELSE 0 END"
    g = " + ".join(
        cell.format(x=x, row=row, col=col)
        for x, row, col in (
            ("a", "(a + b)", "pos"),
            ("b", "(a + b)", "neg"),
            ("(pos - a)", "(pos + neg - a - b)", "pos"),
            ("(neg - b)", "(pos + neg - a - b)", "neg"),
        )
    )
    best = table.select("term", F.expr(f"2 * ({g})").alias("g")).filter(F.col("g") >= MIN_G).orderBy(F.round("g", 6).desc(), "term").limit(features)
    return sorted(r["term"] for r in best.collect())


def train(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = SAMPLE_PER_CLASS,
    features: int = FEATURES,
    buckets: int = BUCKETS,
    rank: int = RANK,
    epochs: int = EPOCHS,
    min_rows: int = MIN_ROWS,
    seed: int = 3,
) -> FactorizationMachine:
    """Fit on a bounded sample of `labels` (`doc_id`, `target` 0 or 1).

    Terms are words and beginnings of words. The driver gets at most
    2 * `per_class` rows of at most `features` term numbers. Without rows of both
    classes the model gives the known class's frequency (0.5 without any).
    """
    sampled = stored(sampled_terms(docs, labelled_sample(labels, per_class, [0, 1]), word_terms, buckets), "terms")
    index = np.full(buckets, -1, dtype=np.int32)
    chosen = _telling(sampled, features, min_rows)
    index[chosen] = np.arange(len(chosen))
    numbers = sampled.mapInArrow(_narrowed(index), "target int, weight double, terms array<int>")
    rows = numbers.orderBy("target", "weight", "terms").toArrow()
    n = len(chosen)
    linear, factors = np.zeros(n), np.random.Generator(np.random.PCG64(seed)).normal(0, 0.01, (n, rank))
    target = rows["target"].to_numpy().astype(float)
    weight = rows["weight"].to_numpy().astype(float)
    bias = np.zeros(1)
    if not len(target) or target.min() == target.max():
        return FactorizationMachine(index, float(30 * (2 * target.mean() - 1)) if len(target) else 0.0, linear, factors)
    weight /= weight.sum()
    lists = rows["terms"].combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    x = Sparse(lengths, lists.flatten().to_numpy(), np.ones(len(lists.flatten())))
    bias[0] = np.log((weight @ target) / (1 - weight @ target))
    adam = Adam(0.05)
    for _ in range(epochs):
        sums = np.stack([x.dot(v) for v in factors.T], axis=1)
        squares = np.stack([x.dot(v * v) for v in factors.T], axis=1)
        margin = bias[0] + x.dot(linear) + (sums * sums - squares).sum(axis=1) / 2
        slope = weight * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - target)
        seen = x.transposed(slope, n)
        pairs = np.stack([x.transposed(slope * s, n) for s in sums.T], axis=1) - factors * seen[:, None]
        adam.step(
            bias=(bias, np.array([slope.sum()])),
            linear=(linear, seen + 1e-4 * linear),
            factors=(factors, pairs + 1e-3 * factors),
        )
    return FactorizationMachine(index, float(bias[0]), linear, factors)


def _narrowed(index: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("terms")
            rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            feature = index[lists.flatten().to_numpy()]
            known = feature >= 0
            bounds = np.searchsorted(rows[known], np.arange(len(lists) + 1)).astype(np.int32)
            kept = pa.ListArray.from_arrays(pa.array(bounds), pa.array(feature[known]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("target"), batch.column("weight"), kept], ["target", "weight", "terms"]
            )

    return run


def scored(docs: DataFrame, model: FactorizationMachine, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The `carry` columns and `score` (0 to 1) of every row; null and empty texts get the score of no terms.

    One pass over the texts, no shuffle. The model's size is fixed by its parameters.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def prepare():
        model = shared.value
        size = np.uint64(len(model.index))

        def compute(data, offsets):
            rows, hashes = word_terms(data, offsets)
            return [model.scores(rows, (hashes % size).astype(np.int64), len(offsets) - 1)]

        return compute

    return with_text_columns(docs, carry, [StructField("score", DoubleType())], prepare)
