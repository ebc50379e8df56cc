"""Drug fills of an analysis window with calculated end dates."""

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxcover.functions import durations
from rxcover.operators.lookup import attach_lookup
from rxcover.schema import DAYS_PER_MONTH, DISPENSED_TYPES

CHRONOLOGICAL = ["person_id", "drug_concept_id", "start_date", "drug_exposure_id"]


def in_window(drug_exposure: DataFrame, start: date | str, end: date | str, dispensed_only: bool = False) -> DataFrame:
    """Fills that start in the closed window, optionally of the dispensed types only."""
    window = [F.lit(str(day)).cast("date") for day in (start, end)]
    fills = drug_exposure.filter(F.col("drug_exposure_start_date").between(*window))
    if dispensed_only:
        fills = fills.filter(F.col("drug_type_concept_id").isin(*DISPENSED_TYPES))
    return fills


def recent_exposures(drug_exposure: DataFrame, months_back: int, as_of: date | str | None = None) -> DataFrame:
    """Fills that start in the last `months_back` months of 30 days."""
    today = F.current_date() if as_of is None else F.lit(str(as_of)).cast("date")
    first = F.date_sub(today, DAYS_PER_MONTH * months_back)
    return drug_exposure.filter(F.col("drug_exposure_start_date").between(first, today))


def drug_median_supply(drug_exposure: DataFrame) -> DataFrame:
    """Median positive days_supply per drug over all fills, whatever their date or type.

    Fills are counted per (drug, days) first, so a drug with most of the fills
    reaches its task as a few hundred distinct day counts.
    """
    counted = (
        drug_exposure.filter(F.col("days_supply") > 0)
        .groupBy("drug_concept_id", "days_supply")
        .agg(F.count("*").alias("fills"))
    )
    return counted.groupBy("drug_concept_id").agg(
        F.percentile("days_supply", 0.5, F.col("fills")).alias("median_days_supply")
    )


def attach_median_supply(fills: DataFrame, drug_exposure: DataFrame) -> DataFrame:
    """Add the drug's median; the medians, two numbers a drug, are sent to the fills.

    Coverage and numbering group the fills by patient and drug. A shuffle by drug
    alone would do for them, and leave all fills of a drug in one task.
    """
    return attach_lookup(fills, drug_median_supply(drug_exposure), "drug_concept_id", broadcast=True)


def _source_columns(fills: DataFrame) -> dict:
    columns = {
        "end": F.col("drug_exposure_end_date"),
        "supply": F.col("days_supply"),
        "refills": F.col("refills"),
    }
    if "median_days_supply" in fills.columns:
        columns["median"] = F.col("median_days_supply")
    return columns


def with_coverage(fills: DataFrame) -> DataFrame:
    """Rename the start and add `end_date`; uses the drug median where one is attached."""
    source = _source_columns(fills)
    start = F.col("drug_exposure_start_date")
    return fills.withColumn("end_date", durations.coverage_end(start, **source)).withColumnRenamed(
        "drug_exposure_start_date", "start_date"
    )


def coverage_fills(
    drug_exposure: DataFrame,
    start: date | str,
    end: date | str,
    dispensed_only: bool = False,
    impute: bool = False,
) -> DataFrame:
    """Fills of the window with start_date and end_date, the input of coverage and gaps."""
    fills = in_window(drug_exposure, start, end, dispensed_only)
    if impute:
        fills = attach_median_supply(fills, drug_exposure)
    return with_coverage(fills)


def drug_exposures(
    drug_exposure: DataFrame,
    start: date | str,
    end: date | str,
    dispensed_only: bool = False,
    impute: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Fill listing with calculated end date and days covered.

    `impute` adds the drug's median days_supply and the imputation method.
    `limit` keeps the first rows by person, drug, start, id and the other columns.
    """
    fills = coverage_fills(drug_exposure, start, end, dispensed_only, impute)
    source = _source_columns(fills)
    columns = [
        "person_id",
        "drug_concept_id",
        "drug_exposure_id",
        "start_date",
        "drug_exposure_end_date",
        "days_supply",
        "refills",
        "quantity",
        "drug_type_concept_id",
        F.col("end_date").alias("calculated_end_date"),
        durations.days_covered(F.col("start_date"), **source).alias("days_covered"),
    ]
    if impute:
        columns.insert(9, "median_days_supply")
        columns.append(durations.imputation_method(**source).alias("imputation_method"))
    listing = fills.select(*columns)
    if limit is None:
        return listing
    rest = [c for c in listing.columns if c not in CHRONOLOGICAL]
    return listing.orderBy(*CHRONOLOGICAL, *rest).limit(limit)

