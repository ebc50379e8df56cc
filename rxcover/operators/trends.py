"""Adherence over time: covered and observed days by calendar month or year.

A merged period is cut at the edges of the calendar cells it touches, one row per
cell and none per day. The days between a patient-drug's first fill and its last
covered day are cut along with the periods, so one pass gives both, and the cells
of a patient-drug add up to its covered days and its treatment duration.
"""

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxcover.functions.classify import adherence_status, pdc_ratio, pdc_units
from rxcover.functions.durations import days_between
from rxcover.functions.ratios import percent, ratio, rounded_ratio
from rxcover.operators.coverage import counted_periods
from rxcover.schema import ADHERENT, MIN_TREATMENT_DAYS, PATIENT_DRUG, PDC_THRESHOLD

MONTHS = {"month": 1, "quarter": 3, "year": 12}


def _cell(day: Column, unit: str) -> Column:
    return F.trunc(day, unit)


def _days_inside(first: Column, last: Column, cell: Column, cell_end: Column) -> Column:
    days = days_between(F.least(last, cell_end), F.greatest(first, cell)) + 1
    return F.greatest(days, F.lit(0).cast("bigint"))


def calendar_pdc(
    fills: DataFrame,
    unit: str = "month",
    threshold: Decimal | float | str = PDC_THRESHOLD,
    min_treatment_days: int = MIN_TREATMENT_DAYS,
) -> DataFrame:
    """Covered and observed days, PDC and class of every patient-drug in each `month`, `quarter` or `year`.

    `period` is the first day of the cell. Observed are the days from the first
    fill to the last covered day, so cells without any covered day appear as well.
    A period with reversed dates counts its 0 or fewer days where it starts.
    """
    pair = Window.partitionBy(*PATIENT_DRUG)
    start, end, last = F.col("period_start"), F.col("period_end"), F.col("last_day")
    periods = (
        counted_periods(fills)
        .withColumns(
            {
                "next_start": F.lead("period_start").over(pair.orderBy("coverage_group")),
                "first_day": F.min("period_start").over(pair),
                "last_day": F.max("period_end").over(pair),
            }
        )
        .filter(days_between(last, F.col("first_day")) + 1 >= min_treatment_days)
        .withColumn("until", F.least(F.date_sub("next_start", 1), last))
    )
    step = F.make_interval(months=F.lit(MONTHS[unit]))
    final = _cell(F.greatest(F.col("until"), end, start), unit)
    cut = periods.withColumn("period", F.explode(F.sequence(_cell(start, unit), final, step)))
    cell, cell_end = F.col("period"), F.date_sub(F.add_months("period", MONTHS[unit]), 1)
    at_start = F.when(cell == _cell(start, unit), (days_between(end, start) + 1) * F.col("repeats"))
    pieces = cut.select(
        *PATIENT_DRUG,
        "period",
        F.when(end >= start, _days_inside(start, end, cell, cell_end))
        .otherwise(F.coalesce(at_start, F.lit(0).cast("bigint")))
        .alias("covered_days"),
        _days_inside(start, F.col("until"), cell, cell_end).alias("observed_days"),
    )
    cells = (
        pieces.groupBy(*PATIENT_DRUG, "period")
        .agg(F.sum("covered_days").alias("covered_days"), F.sum("observed_days").alias("observed_days"))
        .filter((F.col("observed_days") > 0) | (F.col("covered_days") != 0))
        .withColumn("pdc", pdc_ratio(F.col("covered_days"), F.col("observed_days")))
    )
    return cells.withColumn("adherence_status", adherence_status(F.col("pdc"), threshold)).withColumn(
        "pdc", F.col("pdc").cast("double")
    )


def adherence_trend(cells: DataFrame, by: str | None = None) -> DataFrame:
    """Patients, combinations, days and adherence per calendar cell, and the change since the cell before.

    `by` names a column to keep apart, such as `drug_name`; rows without it are
    left out. `pooled_pdc` is covered over observed days, `mean_pdc` the mean over
    combinations. Rows are counted per patient first, so a drug or month with most
    of the rows spreads over the cluster.
    """
    keys = [by, "period"] if by else ["period"]
    rows = cells.filter(F.col(by).isNotNull()) if by else cells
    one = rows.withColumns(
        {"units": pdc_units(F.col("pdc")), "adherent": (F.col("adherence_status") == ADHERENT).cast("bigint")}
    )
    per_patient = one.groupBy(*keys, "person_id").agg(
        F.count("*").alias("combinations"),
        *[F.sum(c).alias(c) for c in ("covered_days", "observed_days", "units", "adherent")],
    )
    totals = per_patient.groupBy(*keys).agg(
        F.count("*").alias("patients"),
        *[F.sum(c).alias(c) for c in ("combinations", "covered_days", "observed_days", "units", "adherent")],
    )
    along = Window.partitionBy(*([by] if by else [F.lit(0)])).orderBy("period")  # one row per cell
    return (
        totals.withColumn("pooled_pdc", rounded_ratio(F.col("covered_days"), F.col("observed_days"), 4))
        .withColumn("change", F.round(F.col("pooled_pdc") - F.lag("pooled_pdc").over(along), 4))
        .select(
            *keys,
            "patients",
            "combinations",
            "covered_days",
            "observed_days",
            "pooled_pdc",
            ratio(F.col("units"), F.col("combinations") * 10000).alias("mean_pdc"),
            percent(F.col("adherent"), F.col("combinations")).alias("pct_adherent"),
            "change",
        )
    )
