"""Roll-ups of patient-drug results and of gap listings.

PDC is summed, ranked and binned as an integer number of ten-thousandths, so
results do not depend on the order of summation. Roll-ups that need a median or
a deviation next to a distinct count of patients first count rows per value and
per patient (`_counted`); the final groups then read those counts, never the
rows themselves.
"""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxcover.functions.classify import pdc_bin, pdc_bins_right_closed, pdc_units
from rxcover.functions.ratios import percent, ratio, rounded_ratio
from rxcover.schema import ADHERENT, GAP_SEVERITIES, HISTOGRAM_BINS, MIN_PATIENTS_REPORT, MODERATE, NON_ADHERENT

ADDED_PER_VALUE = {
    "adherent": F.sum,
    "moderate": F.sum,
    "non_adherent": F.sum,
    "num_gaps": F.sum,
    "total_gap_days": F.sum,
    "max_gap_days": F.max,
    "max_total_gap_days": F.max,
}


def _with_units(pdc: DataFrame) -> DataFrame:
    return pdc.withColumn("pdc_units", pdc_units(F.col("pdc")))


def _counted(
    df: DataFrame,
    value: str,
    measures: dict,
    groupings: Iterable[list[str]] = ((),),
    rows: Column | None = None,
) -> DataFrame:
    """Rows counted per value and, beside them, one row per patient, within each grouping.

    All groupings share one pass and one shuffle, whose keys hold the value or
    the patient, so no group of rows meets in one task. In the result `value` is
    NULL on patient rows, `person_id` and all counts are NULL on value rows, and
    `level` tells the groupings apart (one bit per group column, set if unused).
    `rows` sums the rows that each row stands for; without it each is one.
    """
    groupings = [list(g) for g in groupings]
    columns = list(dict.fromkeys(c for g in groupings for c in g))
    sets = [[*g, key] for g in groupings for key in (value, "person_id")]
    counts = df.groupingSets(sets, *columns, value, "person_id").agg(
        F.grouping_id().alias("grouping"),
        (F.count("*") if rows is None else rows).alias("rows"),
        *[function(column).alias(column) for column, function in measures.items()],
    )
    per_value = F.col("grouping").bitwiseAND(2) == 0
    return counts.select(
        F.shiftright("grouping", 2).alias("level"),
        *columns,
        value,
        "person_id",
        *[F.when(per_value, F.col(c)).alias(c) for c in ("rows", *measures)],
    )


def _counted_pdc(pdc: DataFrame, groupings: Iterable[list[str]] = ((),)) -> DataFrame:
    status = F.col("adherence_status")
    flagged = _with_units(pdc).withColumns(
        {
            "adherent": (status == ADHERENT).cast("bigint"),
            "moderate": (status == MODERATE).cast("bigint"),
            "non_adherent": (status == NON_ADHERENT).cast("bigint"),
            "max_total_gap_days": F.col("total_gap_days"),
        }
    )
    return _counted(flagged, "pdc_units", ADDED_PER_VALUE, groupings)


def _total(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0).cast("bigint"))


def _patients() -> Column:
    return F.count("person_id")


def _sum_units() -> Column:
    return F.sum(F.col("pdc_units") * F.col("rows"))


def _mean_pdc() -> Column:
    return ratio(_sum_units(), _total("rows") * 10000)


def _median_units() -> Column:
    return F.percentile("pdc_units", 0.5, F.col("rows"))


def _std_pdc() -> Column:
    """Sample deviation from exact integer sums; NULL for a single row."""
    wide = "decimal(38,0)"
    units, rows = F.col("pdc_units").cast(wide), F.col("rows").cast(wide)
    number, total = _total("rows").cast("double"), _sum_units().cast("double")
    squares = F.sum((units * units * rows).cast(wide)).cast("double")
    variance = (squares - total * total / number) / (number - 1)
    return F.when(number > 1, F.sqrt(F.greatest(variance, F.lit(0.0))) / 10000)


def summary_overall(pdc: DataFrame) -> DataFrame:
    """One row: patients, combinations, adherent share, PDC and gap means."""
    return _counted_pdc(pdc).agg(
        _patients().alias("total_patients"),
        _total("rows").alias("total_patient_drug_combinations"),
        _total("adherent").alias("adherent_count"),
        percent(F.sum("adherent"), F.sum("rows")).alias("adherent_percentage"),
        _mean_pdc().alias("avg_pdc"),
        (_median_units() / 10000).alias("median_pdc"),
        ratio(F.sum("num_gaps"), F.sum("rows")).alias("avg_gaps"),
        ratio(F.sum("total_gap_days"), F.sum("rows")).alias("avg_gap_days"),
    )


def _per_drug(pdc: DataFrame):
    named = pdc.filter(F.col("drug_name").isNotNull())
    return _counted_pdc(named, [["drug_name"]]).groupBy("drug_name")


def summary_by_drug(pdc: DataFrame) -> DataFrame:
    """Unrounded statistics per drug name; drugs without a name are left out."""
    return _per_drug(pdc).agg(
        _patients().alias("unique_patients"),
        _mean_pdc().alias("mean_pdc"),
        (_median_units() / 10000).alias("median_pdc"),
        _std_pdc().alias("std_pdc"),
        percent(F.sum("adherent"), F.sum("rows")).alias("pct_adherent"),
        ratio(F.sum("num_gaps"), F.sum("rows")).alias("avg_gaps"),
        ratio(F.sum("total_gap_days"), F.sum("rows")).alias("avg_gap_days"),
    )


def drug_summary(pdc: DataFrame) -> DataFrame:
    """Statistics per drug name at 3 digits; drugs without a name are left out."""
    rows = F.sum("rows")
    return _per_drug(pdc).agg(
        _patients().alias("unique_patients"),
        rounded_ratio(_sum_units(), rows * 10000, 3).alias("mean_pdc"),
        rounded_ratio((_median_units() * 2).cast("bigint"), F.lit(20000), 3).alias("median_pdc"),
        F.round(_std_pdc(), 3).alias("std_pdc"),
        rounded_ratio(F.sum("adherent") * 100, rows, 3).alias("pct_adherent"),
        rounded_ratio(F.sum("num_gaps"), rows, 3).alias("avg_gaps"),
        rounded_ratio(F.sum("total_gap_days"), rows, 3).alias("avg_gap_days"),
        F.max("max_gap_days").alias("max_gap"),
    )


def quick_drug_summary(pdc: DataFrame) -> DataFrame:
    """The five-column form of the drug summary."""
    return drug_summary(pdc).select(
        "drug_name", F.col("unique_patients").alias("patients"), "mean_pdc", "median_pdc", "pct_adherent", "avg_gaps"
    )


def pdc_distribution(pdc: DataFrame) -> DataFrame:
    """Patient-drugs per right-closed PDC bin; empty bins show 0, values in no bin are left out."""
    bins = pdc_bins_right_closed(F.col("pdc_units"))
    counts = _with_units(pdc).agg(*[F.count_if(test).alias(name) for name, test in bins.items()])
    return counts.unpivot([], [F.col(f"`{name}`") for name in bins], "pdc_bin", "combinations")


# In the distribution rows of the report these columns carry a plain 0.
NOT_IN_DISTRIBUTION = [
    "adherent_count",
    "moderately_adherent_count",
    "non_adherent_count",
    "pct_adherent",
    "avg_pdc",
    "min_pdc",
    "max_pdc",
    "stddev_pdc",
    "avg_gaps_per_patient",
    "avg_gap_days_per_patient",
    "max_total_gap_days",
]
REPORT_ORDER = ["Overall", "By Drug", "PDC Distribution"]


def summary_report(pdc: DataFrame, min_patients: int = MIN_PATIENTS_REPORT) -> DataFrame:
    """Overall, per drug (unnamed drugs together) and per left-closed PDC bin, in one table.

    The three groupings share one pass over the PDC rows.
    """
    binned = pdc.withColumn("bin", pdc_bin(pdc_units(F.col("pdc"))))
    groups = _counted_pdc(binned, [[], ["drug_name"], ["bin"]]).groupBy("level", "drug_name", "bin")
    by_drug, by_bin = F.col("level") == 1, F.col("level") == 2
    rows = F.sum("rows")
    measures = {
        "unique_patients": _patients(),
        "total_patient_drug_combinations": rows,
        "adherent_count": F.sum("adherent"),
        "moderately_adherent_count": F.sum("moderate"),
        "non_adherent_count": F.sum("non_adherent"),
        "pct_adherent": rounded_ratio(F.sum("adherent") * 100, rows, 2),
        "avg_pdc": rounded_ratio(_sum_units(), rows * 10000, 4),
        "min_pdc": F.min("pdc_units") / 10000,
        "max_pdc": F.max("pdc_units") / 10000,
        "stddev_pdc": F.round(_std_pdc(), 4),
        "avg_gaps_per_patient": rounded_ratio(F.sum("num_gaps"), rows, 2),
        "avg_gap_days_per_patient": rounded_ratio(F.sum("total_gap_days"), rows, 2),
        "max_total_gap_days": F.max("max_total_gap_days"),
    }
    rolled = groups.agg(*[measure.alias(name) for name, measure in measures.items()])
    labelled = rolled.filter(~by_drug | (F.col("unique_patients") >= min_patients)).select(
        F.when(by_drug, "By Drug").when(by_bin, "PDC Distribution").otherwise("Overall").alias("category"),
        F.when(by_drug, F.col("drug_name")).when(by_bin, F.col("bin")).otherwise("All Drugs").alias("subcategory"),
        *[
            F.when(by_bin, F.lit(0)).otherwise(F.col(c)).alias(c) if c in NOT_IN_DISTRIBUTION else c
            for c in measures
        ],
    )
    # Without any PDC row the overall line still appears, with counts of 0.
    counts = [c for c in measures if c.endswith(("count", "patients", "combinations"))]
    overall = pdc.sparkSession.range(1).select(
        F.lit("Overall").alias("category"),
        F.lit("All Drugs").alias("subcategory"),
        *[F.lit(0).cast("bigint").alias(c) for c in counts],
    )
    return (
        labelled.unionByName(overall, allowMissingColumns=True)
        .groupBy("category", "subcategory")
        .agg(*[F.max(c).alias(c) for c in measures])
    )


def in_report_order(report: DataFrame) -> DataFrame:
    return report.orderBy(F.array_position(F.lit(REPORT_ORDER), F.col("category")), "subcategory")


def with_report_position(report: DataFrame) -> DataFrame:
    """The order of `in_report_order` as a column, from 1, numbered within each category and moved behind those before."""
    everything, own = Window.partitionBy(), Window.partitionBy("category").orderBy("subcategory")
    before = F.lit(0).cast("bigint")
    sizes = report.groupBy("category").agg(F.count("*").alias("_rows"))  # one row a category, at most three
    earlier = F.lit(0).cast("bigint")
    for position, name in enumerate(REPORT_ORDER):
        size = F.coalesce(F.sum(F.when(F.col("category") == name, F.col("_rows"))).over(everything), before)
        earlier = earlier + F.when(F.array_position(F.lit(REPORT_ORDER), F.col("category")) > position + 1, size).otherwise(before)
    sizes = sizes.select("category", earlier.alias("_before"))
    numbered = report.withColumn("position", F.row_number().over(own))
    return numbered.join(sizes, "category").select(*report.columns, (F.col("position") + F.col("_before")).alias("position"))


def overall_statistics(pdc: DataFrame) -> DataFrame:
    """One row of patient, adherence, PDC and gap statistics.

    Everyone who is not adherent counts as non-adherent here, moderate included.
    """
    stats = _counted_pdc(pdc).agg(
        _patients().alias("total_patients"),
        _total("rows").alias("total_combinations"),
        _total("adherent").alias("adherent_count"),
        percent(F.sum("adherent"), F.sum("rows")).alias("adherent_pct"),
        _mean_pdc().alias("mean_pdc"),
        (_median_units() / 10000).alias("median_pdc"),
        _std_pdc().alias("std_pdc"),
        (F.min("pdc_units") / 10000).alias("min_pdc"),
        (F.max("pdc_units") / 10000).alias("max_pdc"),
        ratio(F.sum("num_gaps"), F.sum("rows")).alias("avg_gaps"),
        ratio(F.sum("total_gap_days"), F.sum("rows")).alias("avg_gap_days"),
        F.max("max_gap_days").alias("max_gap_days"),
    )
    return stats.withColumns(
        {
            "avg_drugs_per_patient": ratio(F.col("total_combinations"), F.col("total_patients")),
            "non_adherent_count": F.col("total_combinations") - F.col("adherent_count"),
            "non_adherent_pct": 100 - F.col("adherent_pct"),
        }
    )


def status_distribution(pdc: DataFrame) -> DataFrame:
    """Count and share per adherence class."""
    counts = pdc.groupBy("adherence_status").agg(F.count("*").alias("combinations"))
    everything = Window.partitionBy()  # three rows at most
    return counts.withColumn("percentage", percent(F.col("combinations"), F.sum("combinations").over(everything)))


def pdc_histogram(pdc: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins from the lowest to the highest PDC, the last one closed.

    Rows are first counted per distinct PDC value; only those counts are binned.
    """
    values = _with_units(pdc).groupBy("pdc_units").agg(F.count("*").alias("combinations"))
    everything = Window.partitionBy()  # distinct PDC values, about 10,000
    units, low, high = F.col("pdc_units"), F.col("low"), F.col("high")
    ranged = values.withColumns({"low": F.min(units).over(everything), "high": F.max(units).over(everything)})
    # A single value gets a range of one PDC unit around it.
    single = low == high
    ranged = ranged.withColumns(
        {"low": F.when(single, low - 5000).otherwise(low), "high": F.when(single, high + 5000).otherwise(high)}
    )
    position = F.least(F.lit(bins - 1), F.floor((units - low) * bins / (high - low))).cast("bigint")
    filled = ranged.select("low", "high", position.alias("bin"), "combinations")
    every_bin = ranged.select("low", "high").distinct()
    every_bin = every_bin.select("low", "high", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    empty = every_bin.withColumn("combinations", F.lit(0).cast("bigint"))
    counted = filled.unionByName(empty).groupBy("low", "high", "bin").agg(F.sum("combinations").alias("combinations"))

    def edge(step: Column) -> Column:
        return (low * bins + step * (high - low)).cast("double") / (bins * 10000)

    return counted.select(
        F.col("bin").cast("bigint").alias("bin"),
        edge(F.col("bin")).alias("lower_edge"),
        edge(F.col("bin") + 1).alias("upper_edge"),
        "combinations",
    )


def _gap_rows(gaps: DataFrame) -> DataFrame:
    """A listing as counts of one; counts as they are."""
    return gaps if "gaps" in gaps.columns else gaps.withColumn("gaps", F.lit(1).cast("bigint"))


def gap_by_drug(gaps: DataFrame) -> DataFrame:
    """Gap statistics per drug name at 2 digits, of a listing or of `gap_counts`; drugs without a name are left out."""
    critical = F.contains("gap_severity", F.lit("Critical"))
    named = (
        _gap_rows(gaps)
        .filter(F.col("drug_name").isNotNull())
        .withColumn("critical_gaps", F.when(critical, F.col("gaps")).otherwise(F.lit(0).cast("bigint")))
    )
    counts = _counted(named, "gap_days", {"critical_gaps": F.sum}, [["drug_name"]], F.sum("gaps"))
    return counts.groupBy("drug_name").agg(
        _patients().alias("unique_patients"),
        F.sum("rows").alias("total_gaps"),
        rounded_ratio(F.sum(F.col("gap_days") * F.col("rows")), F.sum("rows"), 2).alias("avg_gap_days"),
        F.percentile("gap_days", 0.5, F.col("rows")).alias("median_gap_days"),
        F.max("gap_days").alias("max_gap_days"),
        F.sum("critical_gaps").alias("critical_gaps"),
    )


def gap_severity_distribution(gaps: DataFrame) -> DataFrame:
    return _gap_rows(gaps).groupBy("gap_severity").agg(F.sum("gaps").alias("gaps"))


def gap_totals(gaps: DataFrame) -> DataFrame:
    """One row: gaps found, patients affected, critical and major gaps, of a listing or of `gap_counts`."""
    critical, major = GAP_SEVERITIES[0][1], GAP_SEVERITIES[1][1]
    severity, number = F.col("gap_severity"), F.col("gaps")

    def total(which: Column) -> Column:
        return F.coalesce(F.sum(F.when(which, number)), F.lit(0).cast("bigint"))

    return _gap_rows(gaps).agg(
        total(F.lit(True)).alias("gaps_found"),
        F.count_distinct("person_id").alias("patients_affected"),
        total(severity == critical).alias("critical_gaps"),
        total(severity == major).alias("major_gaps"),
    )
