"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxcover.llm.shared import stored

SPACE = r"[\x20\x09-\x0D]+"
PREFIX = 64
# Keys of the groups that survive the prefix hash are broadcast up to this many (16 bytes each).
BROADCAST_KEYS = 1_000_000


def normalised(text: str | Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def exact_groups(
    docs: DataFrame, carry: Sequence[str] = (), prefix: int = PREFIX, broadcast_keys: int = BROADCAST_KEYS
) -> DataFrame:
    """`doc_id`, `keep_id`, `group_size`, `kept` and the `carry` columns for every row.

    The first pass groups rows by normalised length and by the hash of the first
    `prefix` characters. Only rows whose group has a second member have their
    full content hashed in the second pass; all others are unique. In a group of
    equal texts the row with the most code points stays, then the smallest
    `doc_id`; null `doc_id`s come last. Of rows that repeat both, any one stays.
    Names of `carry` must not be those of the result. No rows give no rows.

    Groups are combined before every shuffle, so a text that makes up a third of
    all rows costs one row per task; the joins back are on counted keys and leave
    skew to adaptive execution. Intermediate rows hold no text.
    """
    rows = docs.select("doc_id", *carry, F.col("text").alias("_raw"), normalised("text").alias("_text"))
    sized = rows.select(
        "doc_id",
        *carry,
        F.length(F.coalesce("_raw", F.lit(""))).alias("_points"),
        F.length("_text").alias("_length"),
        F.xxhash64(F.substring("_text", 1, prefix)).alias("_prefix"),
        "_text",
    )
    crowded = (
        sized.groupBy("_length", "_prefix")
        .agg(F.count("*").alias("_rows"))
        .filter("_rows > 1")
        .select("_length", "_prefix", F.lit(True).alias("_crowded"))
    )
    crowded = stored(crowded, "crowded")
    few = crowded.count() <= broadcast_keys
    hashed = stored(
        sized.join(F.broadcast(crowded) if few else crowded, ["_length", "_prefix"], "left").select(
            "doc_id",
            *carry,
            "_points",
            F.when(F.col("_crowded"), F.unhex(F.sha2("_text", 256))).alias("_hash"),
            F.monotonically_increasing_id().alias("_id"),
        ),
        "hashed",
    )
    first = F.struct((-F.col("_points")).alias("points"), F.col("doc_id").isNull().alias("none"), "doc_id", "_id")
    groups = (
        hashed.filter(F.col("_hash").isNotNull())
        .groupBy("_hash")
        .agg(F.min(first).alias("_first"), F.count("*").alias("group_size"))
        .filter("group_size > 1")
    )
    # A table of its own, so that the join below shuffles both sides and can split a large group.
    groups = stored(groups, "groups")
    alone = hashed.filter(F.col("_hash").isNull())
    joined = (
        hashed.filter(F.col("_hash").isNotNull())
        .join(groups, "_hash", "left")
        .unionByName(alone, allowMissingColumns=True)
    )
    grouped = F.col("_first").isNotNull()
    return joined.select(
        "doc_id",
        F.when(grouped, F.col("_first.doc_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (~grouped | (F.col("_id") == F.col("_first._id"))).alias("kept"),
        *carry,
    )
