"""Profiles of the fill table, each in one pass."""

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxcover.functions.ratios import rounded_ratio
from rxcover.operators.sequence import BLOCK_BITS, slice_edges
from rxcover.schema import DISPENSED_TYPES

START = "drug_exposure_start_date"


def database_info(drug_exposure: DataFrame) -> DataFrame:
    """Row count, date range and distinct patients and drugs.

    Rows are reduced to patient-drugs first; the two distinct counts then run on
    those.
    """
    pairs = drug_exposure.groupBy("person_id", "drug_concept_id").agg(
        F.count("*").alias("rows"), F.min(START).alias("first"), F.max(START).alias("last")
    )
    return pairs.agg(
        F.coalesce(F.sum("rows"), F.lit(0).cast("bigint")).alias("total_drug_exposures"),
        F.min("first").alias("min_date"),
        F.max("last").alias("max_date"),
        F.count_distinct("person_id").alias("unique_patients"),
        F.count_distinct("drug_concept_id").alias("unique_drugs"),
    )


def days_supply_null_stats(drug_exposure: DataFrame) -> DataFrame:
    missing = F.count_if(F.col("days_supply").isNull())
    return drug_exposure.agg(
        F.count("*").alias("total"),
        missing.alias("null_count"),
        rounded_ratio(missing * 100, F.count("*"), 2).alias("pct_null"),
    )


def actual_date_range(drug_exposure: DataFrame) -> DataFrame:
    """First and last start date as text, with the number of fills."""
    return drug_exposure.agg(
        F.min(START).cast("string").alias("start_date"),
        F.max(START).cast("string").alias("end_date"),
        F.count("*").alias("total_records"),
    )


def drug_type_counts(drug_exposure: DataFrame, limit: int = 20) -> DataFrame:
    """Most frequent drug types."""
    counts = drug_exposure.groupBy("drug_type_concept_id").agg(F.count("*").alias("record_count"))
    return counts.orderBy(F.desc("record_count"), "drug_type_concept_id").limit(limit)


def null_profile(drug_exposure: DataFrame) -> DataFrame:
    """Missing start dates and duration fields, and how many fills lack all of the latter."""
    fields = {
        "null_start_dates": F.col(START),
        "null_end_dates": F.col("drug_exposure_end_date"),
        "null_days_supply": F.col("days_supply"),
        "null_refills": F.col("refills"),
    }
    durations = [column.isNull() for name, column in fields.items() if name != "null_start_dates"]
    return drug_exposure.agg(
        F.count("*").alias("total_records"),
        *[F.count_if(column.isNull()).alias(name) for name, column in fields.items()],
        F.count_if(durations[0] & durations[1] & durations[2]).alias("all_duration_fields_null"),
    )


def column_null_counts(df: DataFrame) -> DataFrame:
    """Missing values of every column, one row each."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column_name", "null_count")


QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def _quartiles(counts: DataFrame, sizes: DataFrame, block_bits: int) -> DataFrame:
    """Exact quartiles per `column_name` from the number `n` of each value `x`.

    The rank of every distinct value is the number of rows below it, by a scan
    over blocks of values, so no task holds more than 2**block_bits of a column's
    values. The value at a rank is then the largest one that starts at or below it.
    """
    keys = ["column_name", "_region", "_block", "x"]
    blocks = {"_region": F.shiftright("x", 2 * block_bits), "_block": F.shiftright("x", block_bits)}
    none = F.lit(0).cast("bigint")
    values = counts.filter(F.col("x").isNotNull()).withColumns(blocks)
    values = values.select(*keys, F.col("n").alias("_rows"), none.alias("_head"), none.alias("_tail"))
    ranked = slice_edges(values, [keys[:depth] for depth in range(1, len(keys) + 1)])
    ranked = ranked.select("column_name", "x", "_before").join(sizes, "column_name")

    def at(place: Column) -> Column:
        return F.max(F.when(F.col("_before") <= place, F.col("x")))

    place = {name: F.lit(share) * (F.col("count") - 1).cast("double") for name, share in QUARTILES.items()}
    found = ranked.groupBy("column_name", "count").agg(
        *[at(F.floor(where)).alias(f"{name}_low") for name, where in place.items()],
        *[at(F.ceil(where)).alias(f"{name}_high") for name, where in place.items()],
    )

    def between(name: str) -> Column:
        where, low, high = place[name], F.col(f"{name}_low"), F.col(f"{name}_high")
        part = where - F.floor(where)
        return F.when(low == high, low.cast("double")).otherwise((1 - part) * low + part * high)

    return found.select("column_name", *[between(name).alias(name) for name in QUARTILES])


def describe_numbers(df: DataFrame, columns: list[str], block_bits: int = BLOCK_BITS) -> DataFrame:
    """Count, mean, deviation, exact quartiles and range of integer columns, one row each.

    Values are counted first, combined before the shuffle. All but the quartiles
    are sums over these counts; the quartiles come from a scan over them, so a
    column with very many distinct values spreads over the cluster. Sums are exact
    decimals, so the deviation does not depend on the order of summation.
    """
    values = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("bigint").alias("x")) for c in columns])
    counts = df.select(F.explode(values).alias("v")).groupBy("v.column_name", "v.x").agg(F.count("*").alias("n"))
    wide = "decimal(38,0)"
    x, n = F.col("x").cast("decimal(19,0)"), F.col("n").cast("decimal(19,0)")
    rows = F.coalesce(F.sum(F.when(F.col("x").isNotNull(), F.col("n"))), F.lit(0).cast("bigint"))
    total = F.sum((x * n).cast(wide)).cast("double")
    squares = F.sum(((x * x).cast(wide) * n).cast(wide)).cast("double")
    number = F.col("count").cast("double")
    variance = (F.col("squares") - F.col("total") * F.col("total") / number) / (number - 1)
    stats = counts.groupBy("column_name").agg(
        rows.alias("count"),
        total.alias("total"),
        squares.alias("squares"),
        F.min("x").cast("double").alias("min"),
        F.max("x").cast("double").alias("max"),
    )
    quartiles = _quartiles(counts, stats.select("column_name", "count"), block_bits)
    return stats.join(quartiles, "column_name", "left").select(
        "column_name",
        "count",
        (F.col("total") / F.nullif(number, F.lit(0.0))).alias("mean"),
        F.when(F.col("count") > 1, F.sqrt(F.greatest(variance, F.lit(0.0)))).alias("std"),
        "min",
        *QUARTILES,
        "max",
    )


def exposure_profile(exposures: DataFrame) -> DataFrame:
    """Rows, distinct patients and drugs and date extent of a fill listing."""
    return database_info(exposures.withColumnRenamed("start_date", START)).select(
        F.col("total_drug_exposures").alias("rows"), "unique_patients", "unique_drugs", "min_date", "max_date"
    )


def latest_exposures(drug_exposure: DataFrame, limit: int = 10) -> DataFrame:
    """Newest fills by start date, then smallest id, then the other columns."""
    rest = [c for c in drug_exposure.columns if c not in (START, "drug_exposure_id")]
    return drug_exposure.orderBy(F.desc(START), "drug_exposure_id", *rest).limit(limit)


def zero_row_diagnosis(drug_exposure: DataFrame, start: date | str, end: date | str) -> DataFrame:
    """Why a run may return nothing: fills in the window, and of the dispensed types."""
    in_window = F.col(START).between(*[F.lit(str(day)).cast("date") for day in (start, end)])
    counts = drug_exposure.agg(
        F.count_if(in_window).alias("records_in_window"),
        F.count_if(in_window & F.col("drug_type_concept_id").isin(*DISPENSED_TYPES)).alias("records_with_type"),
    )
    return counts.withColumn("verdict", _verdict(F.col("records_in_window"), F.col("records_with_type")))


def _verdict(in_window: Column, with_type: Column) -> Column:
    return (
        F.when(in_window == 0, "no records in date range")
        .when(with_type == 0, "drug type filter excludes all records")
        .otherwise("query should return rows")
    )


def reversed_dates(drug_exposure: DataFrame) -> DataFrame:
    """Fills whose recorded end date lies before their start; they cover 0 or fewer days."""
    return drug_exposure.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("drug_exposure_end_date") < F.col(START)).alias("reversed_dates"),
    )
