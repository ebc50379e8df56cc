"""Gaps between consecutive fills of a patient-drug.

These are gaps between one fill and the next, not between merged periods, so
they do not add up to the gap days of the PDC results.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxcover.functions import durations
from rxcover.functions.classify import gap_severity
from rxcover.operators.coverage import fill_spans
from rxcover.operators.sequence import sequence_fills
from rxcover.schema import MIN_GAP_DAYS, PATIENT_DRUG

FILL_COLUMNS = [*PATIENT_DRUG, "drug_exposure_id", "start_date", "end_date", "days_supply", "quantity"]


def consecutive_gaps(
    fills: DataFrame, min_gap_days: int = MIN_GAP_DAYS, clamp: bool = False, full: bool = False, **slicing: int
) -> DataFrame:
    """Gaps of at least `min_gap_days` with the fills around them.

    Signed gaps are negative on overlap and the last fill has none. With `clamp`
    both count as 0, which shows for thresholds of 0 or less. `full` adds the
    ids around the gap and the quantity before it.
    """
    shown = {"next_start_date": "start_date", **({"next_exposure_id": "drug_exposure_id"} if full else {})}
    sequenced = sequence_fills(
        fills.select(*FILL_COLUMNS),
        number="fill_sequence",
        following=shown,
        **slicing,
    )
    following, end = F.col("next_start_date"), F.col("end_date")
    signed = durations.gap_after(end, following)
    gap = F.when(following > end, signed).otherwise(F.lit(0).cast("bigint")) if clamp else signed
    found = sequenced.withColumn("gap_days", gap).filter(F.col("gap_days") >= min_gap_days)
    columns = [
        *PATIENT_DRUG,
        "fill_sequence",
        F.col("start_date").alias("fill_before_gap_date"),
        F.col("end_date").alias("fill_before_gap_end_date"),
        F.date_add(end, 1).alias("gap_start_date"),
        F.date_sub(following, 1).alias("gap_end_date"),
        "gap_days",
        gap_severity(F.col("gap_days")).alias("gap_severity"),
        F.col("next_start_date").alias("fill_after_gap_date"),
        F.col("days_supply").alias("days_supply_before_gap"),
    ]
    if full:
        columns += [
            F.col("quantity").alias("quantity_before_gap"),
            F.col("drug_exposure_id").alias("fill_before_gap_id"),
            F.col("next_exposure_id").alias("fill_after_gap_id"),
        ]
    return found.select(*columns)


def gap_spans(fills: DataFrame) -> DataFrame:
    """Distinct (start, end) pairs with their number of fills and the last one's id, what `span_gaps` needs."""
    known = fills.filter(F.col("drug_exposure_id").isNotNull() & F.col("start_date").isNotNull())
    return fill_spans(known, F.max("drug_exposure_id").alias("last_id"))


def span_gaps(clamp: bool = False) -> tuple[Column, Column]:
    """Of a row of `gap_spans`: the gap after its last fill, and the gap after each of the others.

    Fills of one day are in order of id, then end. So the last fill of a day is
    the last of the span that comes last by its greatest id and its end; only this
    one is followed by another day. All others are followed by a fill of their own
    day, which is a gap only where they end before they start.
    """
    start, end = F.col("start_date"), F.col("end_date")
    following = F.lead("start_date").over(
        Window.partitionBy(*PATIENT_DRUG).orderBy("start_date", "last_id", "end_date")
    )

    def gap(next_start: Column) -> Column:
        signed = durations.gap_after(end, next_start)
        return F.when(next_start > end, signed).otherwise(F.lit(0).cast("bigint")) if clamp else signed

    return gap(following), gap(start)


def gap_counts(fills: DataFrame, min_gap_days: int = MIN_GAP_DAYS, clamp: bool = False) -> DataFrame:
    """How many gaps of each length a patient-drug has: the listing of `consecutive_gaps`, counted.

    `gap_days`, `gap_severity` and `gaps`, their number. No listing is built:
    fills are counted per pair of dates before the shuffle, and the window sees
    one row per pair of dates.
    """
    after_last, after_others = span_gaps(clamp)
    others = F.col("num_fills") - 1
    both = gap_spans(fills).select(
        *PATIENT_DRUG,
        F.array(
            F.struct(after_last.alias("gap_days"), F.lit(1).cast("bigint").alias("gaps")),
            F.struct(after_others.alias("gap_days"), others.alias("gaps")),
        ).alias("found"),
    )
    found = both.select(*PATIENT_DRUG, F.explode("found").alias("one")).select(*PATIENT_DRUG, "one.*")
    counted = (
        found.filter((F.col("gap_days") >= min_gap_days) & (F.col("gaps") > 0))
        .groupBy(*PATIENT_DRUG, "gap_days")
        .agg(F.sum("gaps").alias("gaps"))
    )
    return counted.select(*PATIENT_DRUG, "gap_days", gap_severity(F.col("gap_days")).alias("gap_severity"), "gaps")


def adjusted_fills(fills: DataFrame, **slicing: int) -> DataFrame:
    """Every fill with the previous fill's end and the days it adds beyond it."""
    source = [F.col("days_supply"), F.col("refills")]
    if "median_days_supply" in fills.columns:
        source.append(F.col("median_days_supply"))
    narrow = fills.select(
        *PATIENT_DRUG,
        "drug_exposure_id",
        "start_date",
        "end_date",
        durations.effective_supply(*source).alias("days_supply"),
    )
    sequenced = sequence_fills(
        narrow, number="fill_number", by_end=True, previous={"prev_end_date": "end_date"}, **slicing
    )
    start, end, previous = F.col("start_date"), F.col("end_date"), F.col("prev_end_date")
    return sequenced.withColumns(
        {
            "gap_days": durations.gap_since(start, previous),
            "overlap_days": durations.overlap_with(start, previous),
            "adjusted_days_covered": durations.days_beyond(start, end, previous),
        }
    )
