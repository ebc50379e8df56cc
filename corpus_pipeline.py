"""The training-data pipeline over `documents`.

    quality      keep what the ordinal classifier does not reject
    exact        of equal texts (white space aside) keep one
    near         of near duplicates (5-word n-grams, Jaccard 0.8) keep one document of each group
    mixing       order the rest by a Pfair schedule of the sources
    tokens       byte-level BPE ids, and the checksum of the decoded bytes

Each stage works on all rows that its predecessor kept, and all but the last
return the columns of their input, whatever they are called. The last one numbers
its rows in the order of the schedule, `mix_position`, worked out again from the
same rows, as Spark does not promise to read files in the order they were
written. Tables without rows pass through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxcover.llm import bpe, exact_dedup, mixing, ngram_join, quality
from rxcover.llm.shared import keep_ids, stored, table


def _packed(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns that an operator needs and the whole row as `_row`, so that no names clash."""
    return docs.select(*columns, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a probability of at least 1/2 of proper text; ratings are those in `labels`."""
    model = quality.train(docs, quality.grades(table(spark, sf_dir, "labels")))
    # Names of their own, so that none is one of the operator's.
    names = [f"column{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index("text")]
    kept = quality.graded(docs.toDF(*names), model, carry=names, text=text).filter("kept")
    return kept.select(names).toDF(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the longest original, then the smallest `doc_id`."""
    groups = exact_dedup.exact_groups(_packed(docs, "doc_id", "text"), carry=["_row"])
    return groups.filter("kept").select("_row.*")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest `doc_id` of each group of near duplicates.

    A `doc_id` goes if all of its rows go; rows with a null `doc_id` stay.
    """
    found = ngram_join.ngram_components(docs)
    dropped = (
        found.filter("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.every(F.col("doc_id") != F.col("component_id")).alias("gone"))
        .filter("gone")
        .select("doc_id")
    )
    dropped = stored(dropped, "dropped")
    return keep_ids(docs, dropped, "doc_id", dropped.count(), anti=True).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order of the schedule."""
    placed = mixing.mixed(_packed(docs, "doc_id", "source")).select("mix_position", "_row")
    return placed.repartitionByRange("mix_position").sortWithinPartitions("mix_position").select("_row.*")


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`doc_id`, `n_tokens`, `ids` (little-endian unsigned 32-bit), `decoded_sha256` and `mix_position` of every row."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    # Stored, as the encoder reads the texts twice.
    placed = stored(mixing.mixed(docs.select("doc_id", "source", "text")).select("doc_id", "mix_position", "text"), "placed")
    tokens = bpe.encoded(placed, bpe.tiktoken_encoder(ranks, public_tokenizers.PATTERN), position="mix_position")
    return bpe.decoded(tokens, ranks).select(
        "doc_id",
        "n_tokens",
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("position").alias("mix_position"),
    )


STAGES = [
    ("quality", quality_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("mixing", mixing_stage),
    ("tokens", tokens_stage),
]

# The classifier, the near-duplicate groups and the ids cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents` of `sf_dir`; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
