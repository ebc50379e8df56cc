"""Ranked lists and the headline figures."""

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxcover.functions.classify import adherence_status, pdc_ratio, pdc_units
from rxcover.functions.ratios import percent, ratio
from rxcover.operators.coverage import span_steps, step_totals, totals_of
from rxcover.operators.gaps import gap_spans, span_gaps
from rxcover.operators.summary import drug_summary, gap_by_drug, gap_totals, overall_statistics
from rxcover.schema import (
    ADHERENT,
    GAP_SEVERITIES,
    HIGH_RISK_GAP_DAYS,
    MIN_GAP_DAYS,
    MIN_PATIENTS_LOW_ADHERENCE,
    MIN_TREATMENT_DAYS,
    NON_ADHERENT,
    PDC_THRESHOLD,
)


def high_risk_patients(pdc: DataFrame, min_gap_days: int = HIGH_RISK_GAP_DAYS) -> DataFrame:
    """Non-adherent patient-drugs with a long gap."""
    return pdc.filter((F.col("adherence_status") == NON_ADHERENT) & (F.col("max_gap_days") >= min_gap_days))


def high_risk(pdc: DataFrame, limit: int = 10) -> DataFrame:
    """The high-risk patient-drugs with the longest gaps."""
    return (
        high_risk_patients(pdc)
        .orderBy(F.desc("max_gap_days"), "person_id", "drug_concept_id")
        .select("person_id", "drug_concept_id", "drug_name", "pdc", "max_gap_days", "num_gaps")
        .limit(limit)
    )


def top_drugs(pdc: DataFrame, limit: int = 20) -> DataFrame:
    """Drugs with the most patients."""
    return drug_summary(pdc).orderBy(F.desc("unique_patients"), "drug_name").limit(limit)


def low_adherence_drugs(
    pdc: DataFrame, min_patients: int = MIN_PATIENTS_LOW_ADHERENCE, limit: int = 10
) -> DataFrame:
    """Drugs with the smallest adherent share among those with enough patients."""
    enough = drug_summary(pdc).filter(F.col("unique_patients") >= min_patients)
    return enough.orderBy("pct_adherent", "drug_name").limit(limit)


def top_gap_drugs(gaps: DataFrame, limit: int = 10) -> DataFrame:
    """Drugs with the most gaps."""
    return gap_by_drug(gaps).orderBy(F.desc("total_gaps"), "drug_name").limit(limit)


def top_drugs_chart(pdc: DataFrame, limit: int = 20, name_length: int = 40) -> DataFrame:
    """Chart data: the drugs with the most patients, lowest mean PDC first, names shortened."""
    name = F.col("drug_name")
    short = F.when(F.length(name) > name_length, F.concat(F.substring(name, 1, name_length), F.lit("...")))
    return (
        top_drugs(pdc, limit)
        .select(
            F.coalesce(short, name).alias("label"),
            "unique_patients",
            "mean_pdc",
            (F.col("mean_pdc") * 100).alias("mean_pdc_pct"),
            "pct_adherent",
        )
        .orderBy("mean_pdc", "label")
    )


def lowest_adherence_lines(pdc: DataFrame, limit: int = 5, name_length: int = 50) -> DataFrame:
    """The first of the low-adherence drugs with shortened names."""
    return low_adherence_drugs(pdc, limit=limit).select(
        F.substring("drug_name", 1, name_length).alias("drug_name"), "pct_adherent", "mean_pdc"
    )


def patients_chart(pdc: DataFrame, limit: int = 10) -> DataFrame:
    """Chart data: patients of the drugs with the most of them, fewest first."""
    return top_drugs(pdc, limit).select("drug_name", "unique_patients").orderBy("unique_patients", "drug_name")


def headline_report(pdc: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row: patients, combinations, adherence rate, mean PDC and gap counts."""
    from_pdc = overall_statistics(pdc).select(
        "total_patients",
        "total_combinations",
        F.col("adherent_pct").alias("adherence_rate"),
        "mean_pdc",
        "avg_gaps",
    )
    from_gaps = gap_totals(gaps)
    both = from_pdc.unionByName(from_gaps, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def headline_of_fills(
    fills: DataFrame,
    threshold: Decimal | float | str = PDC_THRESHOLD,
    min_treatment_days: int = MIN_TREATMENT_DAYS,
    min_gap_days: int = MIN_GAP_DAYS,
) -> DataFrame:
    """The `headline_report` of merged coverage and signed gaps, in one pass over the fills.

    Steps of the merged coverage and gaps between fills come from the same counted
    spans on one partitioning; patients are reduced to a row each before the end.
    """
    after_last, after_others = span_gaps()
    spans = gap_spans(fills).withColumns({"after_last": after_last, "after_others": after_others}).drop("last_id")
    limits = {"gaps_found": (min_gap_days, None)}
    (critical, _), (major, _) = GAP_SEVERITIES[:2]
    limits |= {"critical_gaps": (max(critical, min_gap_days), None), "major_gaps": (max(major, min_gap_days), critical)}

    def inside(gap: Column, low: int, high: int | None) -> Column:
        return (gap >= low) if high is None else (gap >= low) & (gap < high)

    none = F.lit(0).cast("bigint")
    counted = {
        name: F.when(inside(F.col("after_last"), *limit), 1).otherwise(none)
        + F.when(inside(F.col("after_others"), *limit), F.col("num_fills") - 1).otherwise(none)
        for name, limit in limits.items()
    }
    pairs = totals_of(
        step_totals(span_steps(spans.withColumns(counted).drop("after_last", "after_others"))),
        *[F.sum(name).alias(name) for name in counted],
    ).withColumn("pdc", pdc_ratio(F.col("total_days_covered"), F.col("treatment_duration")))
    treated = F.col("treatment_duration") >= min_treatment_days
    adherent = adherence_status(F.col("pdc"), threshold) == ADHERENT
    measures = {
        "combinations": F.when(treated, 1),
        "adherent": F.when(treated & adherent, 1),
        "units": F.when(treated, pdc_units(F.col("pdc"))),
        "num_gaps": F.when(treated, F.col("num_gaps")),
        **{name: F.col(name) for name in counted},
    }
    patients = pairs.groupBy("person_id").agg(
        *[F.coalesce(F.sum(value), none).alias(name) for name, value in measures.items()]
    )
    total = {name: F.coalesce(F.sum(name), none) for name in measures}
    return patients.agg(
        F.count_if(F.col("combinations") > 0).alias("total_patients"),
        total["combinations"].alias("total_combinations"),
        percent(total["adherent"], total["combinations"]).alias("adherence_rate"),
        ratio(total["units"], total["combinations"] * 10000).alias("mean_pdc"),
        ratio(total["num_gaps"], total["combinations"]).alias("avg_gaps"),
        total["gaps_found"].alias("gaps_found"),
        F.count_if(F.col("gaps_found") > 0).alias("patients_affected"),
        total["critical_gaps"].alias("critical_gaps"),
        total["major_gaps"].alias("major_gaps"),
    )
