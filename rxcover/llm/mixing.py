"""Mixing sources to target weights by Pfair scheduling."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rxcover.llm.pfair import earliest_deadline_first, running_total
from rxcover.llm.shared import stored

BLOCK_DOCS = 8
# The sum of all weights must stay below this, so that products with block numbers fit 38 digits.
TOTAL_BELOW = 10**18

_ADDED = {
    "mix_block": "block",
    "mix_slot": "slot",
    "mix_release": "release",
    "mix_deadline": "due",
}


def _key(source: str = "source"):
    """Null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def tempered():
    """Weights in proportion to the square root of a source's `rows`, as whole thousandths."""
    return F.floor(1000 * F.sqrt("rows") + 0.5)


def weighted(sizes: DataFrame, weights: Mapping[str | None, int] | None) -> DataFrame:
    """`_key`, `rows`, `w` of every source, from `sizes` (`_key`, `_rows`)."""
    sources = sizes.groupBy("_key").agg(F.sum("_rows").alias("rows"))
    if weights is None:
        return sources.withColumn("w", tempered())
    given = sizes.sparkSession.createDataFrame(
        [("" if s is None else f"={s}", int(w)) for s, w in weights.items()], "_key string, w bigint"
    )
    return sources.join(given, "_key", "left")


def _windows(blocks: DataFrame, total: int) -> DataFrame:
    """`blocks` (`_key`, `block`, `w`) with the slots from which, and before which, each is to be done."""
    exact = "cast(cast({n} as decimal(19)) * cast({total} as decimal(18)) as decimal(38))"
    return blocks.select(
        F.col("_key").alias("key"),
        "block",
        F.expr(f"{exact.format(n='block', total=total)} div cast(w as decimal(18))").alias("release"),
        F.expr(f"({exact.format(n='block + 1', total=total)} + w - 1) div cast(w as decimal(18))").alias("due"),
    )


def mixed(
    docs: DataFrame, weights: Mapping[str | None, int] | None = None, block_docs: int = BLOCK_DOCS
) -> DataFrame:
    """`docs` with `mix_block`, `mix_slot`, `mix_release`, `mix_deadline` and `mix_position`.

    The rows of a source, in the order of the md5 of `doc_id` (null first; equal
    ids are interchangeable), form blocks of `block_docs`. Block n of a source of
    weight w, of a total of W, is released at floor(n * W / w) and due at
    ceil((n + 1) * W / w). Each slot takes, of the released blocks, the one due
    first (ties: order of the names, null first). So any prefix of the slots holds
    less than one block more or less than each source's share, as long as the source has
    rows left; a slot without a released block stays empty. `mix_position` numbers
    all rows without holes in the order of the slots. Every row gets a position. `weights` are whole
    numbers per source of `docs`, of any number of sources; by default they follow the
    square root of the rows. Columns of these names in `docs` are replaced. An empty
    table gives an empty result.

    The rows of a source are numbered in 4096 parts by the first digits of the
    md5, so a source with a third of all rows spreads over 4096 tasks; blocks are
    scheduled in spans of slots (see `pfair`). Building runs jobs.
    """
    added = [*_ADDED, "mix_position"]
    kept = [c for c in docs.columns if c not in added]

    # The row as one column, so that none of its names meets those used here.
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
        _key().alias("_key"),
        F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit("")).alias("_order"),
    ).withColumn("_part", F.substring("_order", 1, 3))
    sizes = stored(rows.groupBy("_key", "_part").agg(F.count("*").alias("_rows")), "sizes")
    sources = weighted(sizes, weights)
    lacking = [r["_key"] for r in sources.filter("NOT coalesce(w > 0, false)").limit(5).collect()]
    if lacking:
        raise ValueError(f"no positive weight for {[k[1:] if k else None for k in lacking]}")
    total = int(sources.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0])
    if not total:
        return docs.select(*kept, *[F.lit(None).cast("long").alias(c) for c in added])
    if total >= TOTAL_BELOW:
        raise ValueError(f"the weights add up to {total}, which is not below {TOTAL_BELOW}")

    parts = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_rows").over(parts), F.lit(0)).cast("long"))
    # The blocks that hold rows of a part; each begins in one of its parts.
    touched = offsets.join(sources.select("_key", "w", "rows"), "_key").select(
        "_key", "_part", "_before", "w", "rows",
        F.expr(f"explode(sequence(_before div {block_docs}, (_before + _rows - 1) div {block_docs}))").alias("block"),
    )
    blocks = _windows(touched.filter(F.col("block") * block_docs >= F.col("_before")), total)
    horizon = int(blocks.agg(F.max("release")).first()[0]) + 1
    slots = earliest_deadline_first(blocks, horizon).withColumnRenamed("key", "_key")
    held = F.expr(f"least({block_docs}, rows - block * {block_docs})")
    slots = slots.join(sources.select("_key", "rows"), "_key").withColumn("held", held)
    slots = running_total(slots, "held", horizon).select("_key", "block", "slot", "release", "due", "ahead")
    place = F.struct("block", "slot", "release", "due", "ahead")
    places = (
        touched.select("_key", "_part", "_before", "block")
        .join(slots, ["_key", "block"])
        .groupBy("_key", "_part", "_before")
        .agg(F.array_sort(F.collect_list(place)).alias("_places"))
    )
    # The places of a part come with it, so the rows are shuffled by source and part only.
    within = Window.partitionBy("_key", "_part").orderBy("_order")
    numbered = (
        rows.withColumn("_nth", F.row_number().over(within) - 1)
        .join(places, ["_key", "_part"])
        .withColumn("_number", F.col("_before") + F.col("_nth"))
        .withColumn("_at", F.expr(f"_places[cast(_number div {block_docs} - _before div {block_docs} as int)]"))
    )
    return numbered.select(
        "row.*",
        *[F.col(f"_at.{field}").alias(name) for name, field in _ADDED.items()],
        (F.col("_at.ahead") + F.col("_number") % block_docs).alias("mix_position"),
    )
