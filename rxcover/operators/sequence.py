"""Numbering the fills of a patient-drug and looking at their neighbours.

An ordinary window would send a whole patient-drug to one task. Here its fills are
cut along the sort order into slices: by start day, by end day where the order uses
it, and by blocks of ids. Rows are numbered within their slice. A prefix scan over
several levels then carries numbers and neighbours across the edges: a slice becomes
one summary row (number of fills, first and last fill), the slices of a larger block
of ids become one, those of a day become one, and at last come the days of the
patient-drug. Each level is a window of its own over the summaries below it, and hands
what lies before and after down to them.

So no task sees more of a patient-drug than the fills of one day whose ids lie in a
block of 2**block_bits, the 2**block_bits blocks of a larger one, the larger blocks
(at most 2**(64 - 2 * block_bits)) and end days of a day, or its days, however the
ids are spread. Every table takes this way, so the plan does not depend on sizes. It costs a
shuffle of summary rows up and one down for each level. Both sides of a join use the
same exchange where they need the same columns, and the rows are read once; else twice.
"""

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rxcover.schema import PATIENT_DRUG

BLOCK_BITS = 21


def sequence_fills(
    fills: DataFrame,
    number: str,
    by_end: bool = False,
    previous: dict[str, str] | None = None,
    following: dict[str, str] | None = None,
    block_bits: int = BLOCK_BITS,
) -> DataFrame:
    """Add the fill's position and columns of its neighbours, in order of start date
    (then end date if `by_end`), then id, then all other columns (nulls first).

    `previous` and `following` map each new column to the neighbour's column.
    Only fills that agree in every column are interchangeable. Fills without a
    person, drug, id or start date (or end date if `by_end`) are left out.
    """
    previous, following = previous or {}, following or {}
    order = ["start_date", *(["end_date"] if by_end else []), "drug_exposure_id"]
    order += [c for c in fills.columns if c not in (*order, *PATIENT_DRUG)]
    slices = {
        "_day": F.col("start_date"),
        **({"_end": F.col("end_date")} if by_end else {}),
        "_region": F.shiftright("drug_exposure_id", 2 * block_bits),
        "_block": F.shiftright("drug_exposure_id", block_bits),
    }
    keys = [*PATIENT_DRUG, *slices]
    # What a slice shows to its neighbours: of its last fill to the next one, of its first to the one before.
    # Structs, so that a neighbour's null is not taken for none. They have no field that nobody reads: a part of a struct is
    # taken out early on one way through the levels and not on the other, which then share no exchange.
    tail, head = (list(dict.fromkeys(shown.values())) for shown in (previous, following))
    marker = [F.lit(True).alias("_any")]
    in_slice = Window.partitionBy(*keys).orderBy(*order)
    whole_slice = in_slice.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Stated for both sides of the join below, so that neither gets filters of its own and they share one exchange.
    known = reduce(and_, [F.col(key).isNotNull() for key in keys])
    sliced = fills.withColumns(slices).filter(known)
    local = sliced.withColumns(
        {
            number: F.row_number().over(in_slice).cast("bigint"),
            **{name: F.lag(column).over(in_slice) for name, column in previous.items()},
            **{name: F.lead(column).over(in_slice) for name, column in following.items()},
        }
    )
    summary = (
        sliced.withColumns(
            {
                "_place": F.row_number().over(in_slice),
                "_rows": F.count("*").over(whole_slice),
                # Put together behind the window: a struct within it would travel through the shuffle on this side only.
                "_tail": F.struct(*([F.last(c).over(whole_slice).alias(c) for c in tail] or marker)),
            }
        )
        .filter("_place = 1")
        .select(*keys, "_rows", F.struct(*(head or marker)).alias("_head"), "_tail")
    )
    levels = [PATIENT_DRUG, [*PATIENT_DRUG, "_day"], keys[:-1], keys]
    edges = slice_edges(summary, levels)
    return local.join(edges, keys).select(
        *fills.columns,
        (F.col(number) + F.col("_before")).alias(number),
        *[F.coalesce(F.col(name), F.col(f"_last.{column}")).alias(name) for name, column in previous.items()],
        *[F.coalesce(F.col(name), F.col(f"_first.{column}")).alias(name) for name, column in following.items()],
    )


def listing_position(
    rows: DataFrame, order: list[str], name: str = "position", block_bits: int = BLOCK_BITS
) -> DataFrame:
    """Add each row's place in the whole listing, from 1, in the given order, then that of the other columns.

    The first column of the order is an id that is never null. Rows are counted
    per id and the counts scanned over blocks of ids, so no window sees all rows:
    the largest ones see the rows of one id, or 2**block_bits ids or blocks. The
    counts come from the same shuffled rows as the places, so that what leads to
    `rows` runs once.
    """
    first = order[0]
    none = F.lit(0).cast("bigint")
    # Never null, or else the join gives its sides filters of their own, down to the source of `rows`.
    shifts = {"_region": 2 * block_bits, "_block": block_bits}
    blocks = {block: F.coalesce(F.shiftright(first, bits), none) for block, bits in shifts.items()}
    keys = [*blocks, first]
    sliced = rows.withColumns(blocks).filter(F.col(first).isNotNull())
    # Both need all columns of the rows, so both sides of the join use one exchange.
    in_id = Window.partitionBy(*keys).orderBy(*order, *[c for c in rows.columns if c not in order])
    whole_id = in_id.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    local = sliced.withColumn(name, F.row_number().over(in_id))
    counts = local.withColumn("_rows", F.count("*").over(whole_id)).filter(F.col(name) == 1)
    counts = counts.select(*keys, "_rows", none.alias("_head"), none.alias("_tail"))
    edges = slice_edges(counts, [[], keys[:1], keys[:2], keys]).select(*keys, "_before")
    placed = local.join(edges, keys).withColumn(name, F.col(name) + F.col("_before"))
    return placed.select(*rows.columns, name)


def slice_edges(summary: DataFrame, levels: list[list[str]]) -> DataFrame:
    """Fills before each slice, the last of them and the first after it, by a scan over the levels.

    `summary` has `_rows`, `_head` and `_tail` per slice. `levels` are key
    columns, those of what is numbered first, those of the slices last.
    """
    scanned, none = [], F.lit(0).cast("bigint")
    for above, own in reversed(list(zip(levels, levels[1:]))):
        along = Window.partitionBy(*above).orderBy(*own[len(above) :])
        whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        earlier = along.rowsBetween(Window.unboundedPreceding, -1)
        scanned.append(
            summary.select(
                *own,
                F.coalesce(F.sum("_rows").over(earlier), none).alias("_before"),
                F.lag("_tail").over(along).alias("_last"),
                F.lead("_head").over(along).alias("_first"),
            )
        )
        summary = (
            summary.select(
                *above,
                F.row_number().over(along).alias("_place"),
                F.sum("_rows").over(whole).alias("_rows"),
                "_head",
                F.last("_tail").over(whole).alias("_tail"),
            )
            .filter("_place = 1")
            .drop("_place")
        )
    edges = scanned.pop()
    while scanned:
        outer = edges.withColumnsRenamed({"_before": "_outer_before", "_last": "_outer_last", "_first": "_outer_first"})
        inner, shared = scanned.pop(), [c for c in outer.columns if not c.startswith("_outer")]
        edges = inner.join(outer, shared).select(
            *[c for c in inner.columns if c not in ("_before", "_last", "_first")],
            (F.col("_before") + F.col("_outer_before")).alias("_before"),
            F.coalesce("_last", "_outer_last").alias("_last"),
            F.coalesce("_first", "_outer_first").alias("_first"),
        )
    return edges
