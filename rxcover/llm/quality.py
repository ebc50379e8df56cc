"""Text quality by ordinal cumulative-link regression on graded ratings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField

from rxcover.llm.shared import stored
from rxcover.llm.terms import Adam, Sparse, counted, labelled_sample, sampled_terms, style_terms
from rxcover.llm.texts import with_text_columns

BUCKETS = 1 << 20
# Rated rows of each grade that training uses at most.
SAMPLE_PER_GRADE = 4_000
# Terms of the model at most: the most frequent ones in the sample.
FEATURES = 16_384
MIN_ROWS = 10
EPOCHS = 150
# A text is kept if its grade is at least GOOD_FROM with at least this probability.
KEEP_FROM = 0.5
GOOD_FROM = 1


def grades(labels: DataFrame) -> DataFrame:
    """`doc_id`, `target`: 0 for poor text, 1 for proper but toxic text, 2 for proper and clean text."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2))
    return labels.select("doc_id", grade.alias("target"))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class CumulativeLink:
    """P(grade >= k) = sigmoid(w . x - t_k), with one weight vector and thresholds t_1 <= t_2 <= ..."""

    index: np.ndarray  # of each bucket its feature, or -1
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, rows: np.ndarray, buckets: np.ndarray, count: int) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...: a row per text."""
        total = np.bincount(rows, minlength=count)
        feature = self.index[buckets]
        known = feature >= 0
        row, feature, counts = counted(rows[known], feature[known], max(1, len(self.weights)))
        values = np.sqrt(counts / total[row])
        x = np.bincount(row, weights=values * self.weights[feature], minlength=count)
        return _sigmoid(x[:, None] - self.thresholds)


def train(
    docs: DataFrame,
    ratings: DataFrame,
    top_grade: int = 2,
    per_grade: int = SAMPLE_PER_GRADE,
    features: int = FEATURES,
    buckets: int = BUCKETS,
    epochs: int = EPOCHS,
    min_rows: int = MIN_ROWS,
) -> CumulativeLink:
    """Fit on a bounded sample of `ratings` (`doc_id`, `target` from 0 to `top_grade`).

    The driver gets at most (`top_grade` + 1) * `per_grade` rows. A sampled row
    counts for as many as it stands for, each grade at least a tenth of all.
    Without ratings every text has probability 1/2 of each grade or better.
    """
    sample = labelled_sample(ratings, per_grade, list(range(top_grade + 1)))
    sampled = stored(sampled_terms(docs, sample, style_terms, buckets), "terms")
    seen = sampled.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("rows"))
    frequent = seen.filter(F.col("rows") >= min_rows).orderBy(F.desc("rows"), "term").limit(features)
    chosen = sorted(r["term"] for r in frequent.collect())
    index = np.full(buckets, -1, dtype=np.int32)
    index[chosen] = np.arange(len(chosen))
    narrow = sampled.mapInArrow(_narrowed(index), "target int, weight double, terms array<int>, vals array<float>")
    rows = narrow.orderBy("target", "weight", "terms").toArrow()
    thresholds = np.zeros(top_grade)
    weights = np.zeros(len(chosen))
    if not rows.num_rows:
        return CumulativeLink(index, weights, thresholds)
    target = rows["target"].to_numpy().astype(int)
    weight = rows["weight"].to_numpy().astype(float)
    share = np.bincount(target, weights=weight, minlength=top_grade + 1)
    weight *= (np.maximum(share, share.sum() / 10) / np.maximum(share, 1e-9))[target]
    weight /= weight.sum()
    lists = rows["terms"].combine_chunks()
    x = Sparse(
        np.diff(lists.offsets.to_numpy()),
        lists.flatten().to_numpy(),
        rows["vals"].combine_chunks().flatten().to_numpy(),
    )
    # Thresholds are the first one and the logs of the steps between them, so they stay in order.
    first, steps = np.array([0.0]), np.zeros(max(0, top_grade - 1))
    adam = Adam(0.05)
    for _ in range(epochs):
        thresholds = first[0] + np.concatenate([[0.0], np.cumsum(np.exp(steps))])
        margin = x.dot(weights)
        cumulative = np.ones((len(margin), top_grade + 2))  # P(grade >= k), 1 for k = 0 and 0 beyond the top
        cumulative[:, 1:-1] = _sigmoid(margin[:, None] - thresholds)
        cumulative[:, -1] = 0
        at = np.arange(len(margin))
        upper, lower = cumulative[at, target], cumulative[at, target + 1]
        chance = np.maximum(upper - lower, 1e-9)
        slope = -weight * (1 - upper - lower)
        density = cumulative * (1 - cumulative)
        slope_t = np.zeros(top_grade)
        np.add.at(slope_t, np.maximum(target - 1, 0), np.where(target > 0, weight * density[at, target] / chance, 0))
        top = target == top_grade
        np.add.at(slope_t, np.where(top, 0, target), np.where(top, 0, -weight * density[at, target + 1] / chance))
        later = np.cumsum(slope_t[::-1])[::-1]
        adam.step(
            weights=(weights, x.transposed(slope, len(chosen)) + 1e-5 * weights),
            first=(first, later[:1]),
            steps=(steps, later[1:] * np.exp(steps)),
        )
    thresholds = first[0] + np.concatenate([[0.0], np.cumsum(np.exp(steps))])
    return CumulativeLink(index, weights, thresholds)


def _narrowed(index: np.ndarray):
    """The model's terms of each sampled text, with the square root of their share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("terms")
            rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            feature = index[lists.flatten().to_numpy()]
            share = batch.column("counts").flatten().to_numpy() / batch.column("total").to_numpy()[rows]
            known = feature >= 0
            bounds = pa.array(np.searchsorted(rows[known], np.arange(len(lists) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("target"),
                    batch.column("weight"),
                    pa.ListArray.from_arrays(bounds, pa.array(feature[known])),
                    pa.ListArray.from_arrays(bounds, pa.array(np.sqrt(share[known]).astype(np.float32))),
                ],
                ["target", "weight", "terms", "vals"],
            )

    return run


def graded(
    docs: DataFrame,
    model: CumulativeLink,
    carry: Sequence[str] = ("doc_id",),
    good_from: int = GOOD_FROM,
    keep_from: float = KEEP_FROM,
    text: str = "text",
) -> DataFrame:
    """The `carry` columns, `expected_grade`, `tail_probability` of a grade of `good_from` or more, and `kept`.

    Every row of `docs` is graded on its whole text; null and empty texts, and
    texts without a term of the model, get the grade of no terms. One pass, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def prepare():
        model = shared.value
        size = np.uint64(len(model.index))

        def compute(data, offsets):
            rows, hashes = style_terms(data, offsets)
            tails = model.tails(rows, (hashes % size).astype(np.int64), len(offsets) - 1)
            tail = tails[:, good_from - 1]
            return [tails.sum(axis=1), tail, tail >= keep_from]

        return compute

    added = [
        StructField("expected_grade", DoubleType()),
        StructField("tail_probability", DoubleType()),
        StructField("kept", BooleanType()),
    ]
    return with_text_columns(docs, carry, added, prepare, text)
