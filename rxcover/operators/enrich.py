"""Drug names, patient age and conditions for patient-drug results."""

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxcover.operators.lookup import attach_lookup

UNKNOWN_DRUG = "Unknown Drug"
NO_CONDITION = "No Condition Recorded"


def attach_drug_names(
    results: DataFrame,
    concept: DataFrame,
    with_class: bool = True,
    drugs_only: bool = False,
    keep_unmapped: bool = False,
) -> DataFrame:
    """Add drug_name (and concept_class_id) behind the patient-drug key.

    Unmatched drugs stay with NULL names. `drugs_only` matches concepts of the
    drug domain and drops the unmatched, unless `keep_unmapped` labels them.
    """
    names = concept.filter(F.col("domain_id") == "Drug") if drugs_only else concept
    if drugs_only:
        names = names.filter(F.col("concept_name").isNotNull())
    names = names.select(
        F.col("concept_id").alias("drug_concept_id"),
        F.col("concept_name").alias("drug_name"),
        *(["concept_class_id"] if with_class else []),
    )
    how = "inner" if drugs_only and not keep_unmapped else "left"
    named = attach_lookup(results, names, "drug_concept_id", how)
    if drugs_only:
        named = named.withColumn("drug_name", F.coalesce("drug_name", F.lit(UNKNOWN_DRUG)))
    rest = [c for c in results.columns if c not in ("person_id", "drug_concept_id")]
    return named.select(
        "person_id", "drug_concept_id", "drug_name", *(["concept_class_id"] if with_class else []), *rest
    )


def condition_counts(condition_occurrence: DataFrame, concept: DataFrame, until: date | str) -> DataFrame:
    """Occurrences per person and known condition up to a date (no lower bound).

    Occurrences are counted before the concept join, so the join sees one row
    per person and condition.
    """
    counts = (
        condition_occurrence.filter(F.col("condition_start_date") <= F.lit(str(until)).cast("date"))
        .groupBy("person_id", "condition_concept_id")
        .agg(F.count("*").alias("occurrence_count"))
    )
    conditions = concept.filter((F.col("domain_id") == "Condition") & F.col("concept_name").isNotNull()).select(
        F.col("concept_id").alias("condition_concept_id"), "concept_name"
    )
    named = attach_lookup(counts, conditions, "condition_concept_id", "inner")
    return named.select("person_id", "condition_concept_id", "concept_name", "occurrence_count")


def condition_summary(counts: DataFrame) -> DataFrame:
    """Number of conditions and the most frequent one; equal counts go to the smaller id."""
    rank = F.struct(-F.col("occurrence_count"), "condition_concept_id")
    return counts.groupBy("person_id").agg(
        F.count("*").alias("total_conditions"),
        F.min_by("concept_name", rank).alias("primary_condition_name"),
    )


def _age(as_of: date | str | None) -> Column:
    today = F.current_date() if as_of is None else F.lit(str(as_of)).cast("date")
    return (F.year(today) - F.col("year_of_birth")).cast("bigint")


def attach_age(results: DataFrame, person: DataFrame, as_of: date | str | None = None) -> DataFrame:
    """Add age in the calendar year of `as_of` (today by default), NULL without a person row."""
    ages = person.select("person_id", _age(as_of).alias("age"))
    return results.join(ages, "person_id", "left")


def attach_conditions(results: DataFrame, summary: DataFrame) -> DataFrame:
    joined = results.join(summary, "person_id", "left")
    return joined.withColumns(
        {
            "primary_condition": F.coalesce("primary_condition_name", F.lit(NO_CONDITION)),
            "comorbidity_count": F.coalesce("total_conditions", F.lit(0).cast("bigint")),
        }
    ).drop("primary_condition_name", "total_conditions")


def enrich_pdc(
    pdc: DataFrame,
    concept: DataFrame,
    person: DataFrame,
    condition_occurrence: DataFrame,
    until: date | str,
    as_of: date | str | None = None,
    keep_unmapped: bool = False,
) -> DataFrame:
    """PDC results with drug, age and conditions; drugs outside the drug domain are dropped."""
    named = attach_drug_names(pdc, concept, drugs_only=True, keep_unmapped=keep_unmapped)
    summary = condition_summary(condition_counts(condition_occurrence, concept, until))
    full = attach_conditions(attach_age(named, person, as_of), summary)
    added = ["age", "primary_condition", "comorbidity_count"]
    leading = ["person_id", "drug_concept_id", "drug_name", "concept_class_id"]
    rest = [c for c in pdc.columns if c not in leading]
    return full.select(*leading, *added, *rest)
