"""Coverage of one patient by one drug: merged periods and previous-fill adjustment.

Every function first counts equal (start, end) pairs. That aggregation is
combined on the map side and shuffled on the full pair, so a patient-drug with
most of the fills spreads over the cluster; the ordered windows behind it then
see at most one row per pair of calendar days, however many fills there are.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxcover.functions import durations
from rxcover.schema import PATIENT_DRUG


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def fill_spans(fills: DataFrame, *measures: Column) -> DataFrame:
    """Distinct (start, end) pairs of each patient-drug with their number of fills."""
    return fills.groupBy(*PATIENT_DRUG, "start_date", "end_date").agg(F.count("*").alias("num_fills"), *measures)


def merge_steps(fills: DataFrame) -> DataFrame:
    return span_steps(fill_spans(fills))


def span_steps(counted: DataFrame) -> DataFrame:
    """Spans in order, with what each adds to the merged coverage; other columns stay.

    A span starts a new period if it begins more than a day after everything
    before it has ended. Such a span whose own end lies two or more days before
    its start cannot be joined by any other fill: each of its `repeats` fills is
    a period of its own.
    """
    start, end = F.col("start_date"), F.col("end_date")
    in_order = Window.partitionBy(*PATIENT_DRUG).orderBy("start_date", "end_date")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    reached = F.col("covered_until")
    extra = [c for c in counted.columns if c not in (*PATIENT_DRUG, "start_date", "end_date", "num_fills")]
    spans = (
        counted.withColumn("covered_until", F.max("end_date").over(before))
        .withColumn("previous_start", F.lag("start_date").over(in_order))
        .withColumn("previous_end", F.lag("end_date").over(in_order))
    )
    starts = reached.isNull() | (start > F.date_add(reached, 1))
    isolated = F.col("starts_period") & (end < F.date_sub(start, 1))
    after_isolated = reached < F.date_sub(F.col("previous_start"), 1)
    last_period_end = F.when(after_isolated, F.col("previous_end")).otherwise(reached)
    return spans.select(
        *PATIENT_DRUG,
        "start_date",
        "end_date",
        "num_fills",
        "covered_until",
        starts.alias("starts_period"),
        last_period_end.alias("last_period_end"),
        *extra,
    ).withColumn("repeats", F.when(isolated, F.col("num_fills")).otherwise(F.lit(1).cast("bigint")))


def counted_periods(fills: DataFrame) -> DataFrame:
    """Union of overlapping or adjacent fills; a row stands for `repeats` periods with the same dates.

    Several periods in a row are fills with reversed dates that occur several
    times with the same dates; `coverage_group` is the number of the last one.
    """
    so_far = (
        Window.partitionBy(*PATIENT_DRUG)
        .orderBy("start_date", "end_date")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    numbered = merge_steps(fills).withColumn(
        "coverage_group", F.sum(F.when(F.col("starts_period"), F.col("repeats")).otherwise(_zero())).over(so_far)
    )
    return numbered.groupBy(*PATIENT_DRUG, "coverage_group").agg(
        F.min("start_date").alias("period_start"),
        F.max("end_date").alias("period_end"),
        F.sum("num_fills").alias("num_fills"),
        F.max("repeats").alias("repeats"),
    )


def merged_periods(fills: DataFrame) -> DataFrame:
    """Union of overlapping or adjacent fills, one row per coverage period.

    Fills with reversed dates that occur several times with the same dates are
    as many periods of one fill each.
    """
    periods = counted_periods(fills)
    copies = F.explode(F.sequence(F.col("repeats") - 1, F.lit(0).cast("bigint"), F.lit(-1).cast("bigint")))
    return periods.withColumn("later", copies).select(
        *PATIENT_DRUG,
        (F.col("coverage_group") - F.col("later")).alias("coverage_group"),
        "period_start",
        "period_end",
        (F.col("num_fills") / F.col("repeats")).cast("bigint").alias("num_fills"),
        (durations.days_between(F.col("period_end"), F.col("period_start")) + 1).alias("days_covered"),
    )


def coverage_gaps(fills: DataFrame) -> DataFrame:
    """Merged periods with the next period's start and the gap before it (0 at the end)."""
    following = Window.partitionBy(*PATIENT_DRUG).orderBy("coverage_group")
    gap = durations.gap_after(F.col("period_end"), F.col("next_period_start"))
    return (
        merged_periods(fills)
        .withColumn("next_period_start", F.lead("period_start").over(following))
        .withColumn("gap_days", F.coalesce(gap, _zero()))
    )


def merged_totals(fills: DataFrame) -> DataFrame:
    """Covered days, periods and gaps per patient-drug under merged coverage.

    Equal to summing `coverage_gaps`, but taken straight from the ordered spans,
    so neither the period numbers nor the periods have to be built.
    """
    return totals_of(step_totals(merge_steps(fills)), F.sum("num_periods").alias("num_periods"))


def step_totals(steps: DataFrame) -> DataFrame:
    """What each span adds to the totals; columns beyond those of `span_steps` stay."""
    start, end = F.col("start_date"), F.col("end_date")
    starts, repeats = F.col("starts_period"), F.col("repeats")
    known = ("covered_until", "starts_period", "last_period_end", "repeats")
    extra = [c for c in steps.columns if c not in (*PATIENT_DRUG, "start_date", "end_date", "num_fills", *known)]
    length = durations.days_between(end, start) + 1
    fresh = F.greatest(_zero(), durations.days_between(end, F.col("covered_until")))
    gap = F.when(starts, durations.gap_after(F.col("last_period_end"), start))
    own_gap = F.when(repeats > 1, durations.gap_after(end, start))
    return steps.select(
        *PATIENT_DRUG,
        "start_date",
        "end_date",
        "num_fills",
        F.when(starts, length * repeats).otherwise(fresh).alias("days_covered"),
        F.when(starts, repeats).otherwise(_zero()).alias("num_periods"),
        (F.when(gap > 0, 1).otherwise(0) + F.when(own_gap > 0, repeats - 1).otherwise(0)).alias("num_gaps"),
        (F.coalesce(gap, _zero()) + F.coalesce(own_gap * (repeats - 1), _zero())).alias("gap_days"),
        F.greatest(gap, own_gap, _zero()).alias("longest_gap"),
        *extra,
    )


def adjusted_totals(fills: DataFrame) -> DataFrame:
    """The same totals when each fill is adjusted by the previous fill only.

    Of the fills that share both dates the first follows the previous span; each
    of the others follows a fill with its own end date.
    """
    start, end = F.col("start_date"), F.col("end_date")
    in_order = Window.partitionBy(*PATIENT_DRUG).orderBy("start_date", "end_date")
    spans = fill_spans(fills).withColumn("previous_end", F.lag("end_date").over(in_order))
    previous, others = F.col("previous_end"), F.col("num_fills") - 1
    gap, own_gap = durations.gap_since(start, previous), durations.gap_since(start, end)
    steps = spans.select(
        *PATIENT_DRUG,
        "start_date",
        "end_date",
        "num_fills",
        (durations.days_beyond(start, end, previous) + others * durations.days_beyond(start, end, end)).alias(
            "days_covered"
        ),
        (F.when(gap > 0, 1).otherwise(0) + F.when(own_gap > 0, others).otherwise(0)).alias("num_gaps"),
        (gap + others * own_gap).alias("gap_days"),
        F.greatest(gap, F.when(others > 0, own_gap)).alias("longest_gap"),
    )
    return totals_of(steps)


def totals_of(steps: DataFrame, *extra: Column) -> DataFrame:
    totals = steps.groupBy(*PATIENT_DRUG).agg(
        F.sum("days_covered").alias("total_days_covered"),
        F.sum("num_fills").alias("total_fills"),
        *extra,
        F.sum("num_gaps").cast("bigint").alias("num_gaps"),
        F.sum("gap_days").alias("total_gap_days"),
        F.max("longest_gap").alias("max_gap_days"),
        F.min("start_date").alias("first_exposure_date"),
        F.max("end_date").alias("last_exposure_date"),
    )
    duration = durations.days_between(F.col("last_exposure_date"), F.col("first_exposure_date")) + 1
    return totals.withColumn("treatment_duration", duration)
