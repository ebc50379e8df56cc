"""Proportion of days covered (PDC) per patient and drug."""

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxcover.functions.classify import adherence_status, pdc_ratio
from rxcover.functions.ratios import rounded_ratio
from rxcover.operators.coverage import adjusted_totals, merged_totals
from rxcover.schema import MIN_TREATMENT_DAYS, PDC_THRESHOLD

TOTALS = {"merge": merged_totals, "lag": adjusted_totals}


def patient_drug_pdc(
    fills: DataFrame,
    method: str = "merge",
    threshold: Decimal | float | str = PDC_THRESHOLD,
    min_treatment_days: int = MIN_TREATMENT_DAYS,
    cap: bool = False,
    avg_gap: bool = False,
) -> DataFrame:
    """PDC and adherence class of every patient-drug treated long enough.

    `merge` measures the union of all fills, so PDC stays within 1. `lag`
    compares each fill with the one before only, so PDC may pass 1; `cap` then
    limits the reported value to [0, 1] after the class has been decided.
    `avg_gap` adds the mean of the positive gaps, 0 if there is none.
    """
    totals = TOTALS[method](fills).filter(F.col("treatment_duration") >= min_treatment_days)
    scored = totals.withColumn("pdc", pdc_ratio(F.col("total_days_covered"), F.col("treatment_duration")))
    scored = scored.withColumn("adherence_status", adherence_status(F.col("pdc"), threshold))
    value = F.greatest(F.least(F.col("pdc"), F.lit(Decimal(1))), F.lit(Decimal(0))) if cap else F.col("pdc")
    scored = scored.withColumn("pdc", value.cast("double"))
    columns = [
        "person_id",
        "drug_concept_id",
        "pdc",
        "adherence_status",
        "total_days_covered",
        "treatment_duration",
        "total_fills",
        *(["num_periods"] if method == "merge" else []),
        "num_gaps",
        "total_gap_days",
        "max_gap_days",
        *(["avg_gap_days"] if avg_gap else []),
        "first_exposure_date",
        "last_exposure_date",
    ]
    if avg_gap:
        mean = rounded_ratio(F.col("total_gap_days"), F.col("num_gaps"), 4)
        scored = scored.withColumn("avg_gap_days", F.coalesce(mean, F.lit(0.0)))
    return scored.select(*columns)
