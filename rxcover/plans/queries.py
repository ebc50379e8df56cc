"""Named queries over the CDM tables derived from a star-schema folder."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxcover.analysis import AdherenceAnalysis
from rxcover.functions.ratios import plain_types
from rxcover.operators import coverage, enrich, exposures, gaps, quality, report, summary, trends
from rxcover.operators.sequence import listing_position
from rxcover.sources import sinks
from rxcover.sources.cdm import CdmTables
from rxcover.sources.star_schema import AS_OF, WINDOW, cdm_from_star_schema


def _fills(tables: CdmTables, dispensed_only: bool = True) -> DataFrame:
    return exposures.coverage_fills(tables.drug_exposure, *WINDOW, dispensed_only)


def _pdc(tables: CdmTables, profile: str = "dispensed") -> DataFrame:
    return AdherenceAnalysis(tables, profile).calculate_pdc(*WINDOW, as_of=AS_OF)


def _gaps(tables: CdmTables, profile: str = "dispensed", min_gap_days: int = 7) -> DataFrame:
    return AdherenceAnalysis(tables, profile).get_detailed_gaps(*WINDOW, min_gap_days)


def _gap_counts(tables: CdmTables) -> DataFrame:
    return AdherenceAnalysis(tables, "merge").get_gap_counts(*WINDOW)


def _over_time(tables: CdmTables, unit: str) -> DataFrame:
    return AdherenceAnalysis(tables, "dispensed").get_adherence_over_time(*WINDOW, unit)


def _exposures(tables: CdmTables, profile: str = "merge") -> DataFrame:
    return AdherenceAnalysis(tables, profile).get_drug_exposures(*WINDOW)


def _condition_counts(tables: CdmTables) -> DataFrame:
    return enrich.condition_counts(tables.condition_occurrence, tables.concept, WINDOW[1])


def _coverage_listing(tables: CdmTables) -> DataFrame:
    listing = _exposures(tables, "dispensed").withColumnRenamed("calculated_end_date", "end_date")
    return listing.drop("drug_exposure_end_date")


def _patient_age(tables: CdmTables) -> DataFrame:
    patients = tables.drug_exposure.select("person_id").distinct()
    return enrich.attach_age(patients, tables.person, AS_OF)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Deviations at 6 digits, so that the order of summation does not show."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _exported(pdc: DataFrame) -> DataFrame:
    """Written as CSV when the query is built, and read back from there."""
    spark = pdc.sparkSession
    folder = sinks.scratch_folder(spark)
    sinks.export_csv(folder, pdc=pdc)
    return sinks.read_export(spark, folder)["pdc"]


BUILDERS: dict[str, Callable[[CdmTables], DataFrame]] = {
    # fills
    "exposures_base": _exposures,
    "exposures_coverage": _coverage_listing,
    "exposures_imputed": lambda t: _exposures(t, "enriched"),
    "exposures_limited": lambda t: AdherenceAnalysis(t, "merge").get_drug_exposures(*WINDOW, limit=1000),
    "drug_median_supply": lambda t: exposures.drug_median_supply(t.drug_exposure),
    "recent_exposures": lambda t: exposures.recent_exposures(t.drug_exposure, 6, AS_OF),
    # coverage and adherence
    "merged_periods": lambda t: coverage.merged_periods(_fills(t)),
    "coverage_gaps": lambda t: coverage.coverage_gaps(_fills(t)),
    "lag_fill_detail": lambda t: gaps.adjusted_fills(_fills(t, dispensed_only=False)),
    "lag_fill_detail_imputed": lambda t: AdherenceAnalysis(t, "enriched").get_adjusted_fills(*WINDOW),
    "pdc_merge": _pdc,
    "pdc_export": lambda t: _exported(_pdc(t)),
    "pdc_merge_ordered": lambda t: listing_position(
        _pdc(t).select("person_id", "drug_concept_id", "pdc", "adherence_status"), ["person_id", "drug_concept_id"]
    ),
    "gaps_detail_ordered": lambda t: listing_position(
        _gaps(t).select("person_id", "drug_concept_id", "fill_sequence", "gap_days"),
        ["person_id", "drug_concept_id", "fill_sequence"],
    ),
    "pdc_merge_all": lambda t: _pdc(t, "merge"),
    "pdc_merge_avg_gap": lambda t: _pdc(t, "script"),
    "pdc_lag": lambda t: _pdc(t, "lag"),
    "pdc_lag_enriched": lambda t: _pdc(t, "enriched"),
    # adherence over time
    "pdc_by_month": lambda t: _over_time(t, "month"),
    "pdc_by_year": lambda t: _over_time(t, "year"),
    "trend_by_month": lambda t: trends.adherence_trend(_over_time(t, "month")),
    "trend_by_drug": lambda t: trends.adherence_trend(_over_time(t, "quarter"), "drug_name"),
    # gaps between fills
    "gaps_detail": _gaps,
    "gaps_detail_full": lambda t: _gaps(t, "script"),
    "gaps_detail_clamped": lambda t: _gaps(t, "lag", min_gap_days=0),
    "gaps_detail_imputed": lambda t: _gaps(t, "enriched"),
    # enrichment
    "patient_age": _patient_age,
    "condition_counts": _condition_counts,
    "condition_summary": lambda t: enrich.condition_summary(_condition_counts(t)),
    # summaries
    "summary_overall": lambda t: summary.summary_overall(_pdc(t)),
    "summary_by_drug": lambda t: _rounded(summary.summary_by_drug(_pdc(t)), "std_pdc"),
    "summary_distribution_cut": lambda t: summary.pdc_distribution(_pdc(t)),
    "summary_report": lambda t: summary.summary_report(_pdc(t)),
    "summary_report_ordered": lambda t: summary.with_report_position(summary.summary_report(_pdc(t))),
    "notebook_overall": lambda t: _rounded(summary.overall_statistics(_pdc(t, "merge")), "std_pdc"),
    "status_distribution": lambda t: summary.status_distribution(_pdc(t, "merge")),
    "drug_summary": lambda t: summary.drug_summary(_pdc(t, "merge")),
    "drug_summary_quick": lambda t: summary.quick_drug_summary(_pdc(t)),
    "pdc_histogram": lambda t: summary.pdc_histogram(_pdc(t, "merge")),
    "gap_by_drug": lambda t: summary.gap_by_drug(_gap_counts(t)),
    "gap_severity_distribution": lambda t: summary.gap_severity_distribution(_gap_counts(t)),
    "gap_totals": lambda t: summary.gap_totals(_gap_counts(t)),
    # reports
    "top_drugs": lambda t: report.top_drugs(_pdc(t, "merge")),
    "top_drugs_chart": lambda t: report.top_drugs_chart(_pdc(t, "merge")),
    "low_adherence_drugs": lambda t: report.low_adherence_drugs(_pdc(t, "merge")),
    "lowest_adherence_lines": lambda t: report.lowest_adherence_lines(_pdc(t, "merge")),
    "patients_chart": lambda t: report.patients_chart(_pdc(t, "merge")),
    "top_gap_drugs": lambda t: report.top_gap_drugs(_gap_counts(t)),
    "high_risk": lambda t: report.high_risk(_pdc(t)),
    "high_risk_patients": lambda t: report.high_risk_patients(_pdc(t)),
    "headline_report": lambda t: AdherenceAnalysis(t, "merge").get_headline(*WINDOW),
    # data quality
    "database_info": lambda t: quality.database_info(t.drug_exposure),
    "days_supply_null_stats": lambda t: quality.days_supply_null_stats(t.drug_exposure),
    "actual_date_range": lambda t: quality.actual_date_range(t.drug_exposure),
    "drug_type_counts": lambda t: quality.drug_type_counts(t.drug_exposure),
    "null_profile": lambda t: quality.null_profile(t.drug_exposure),
    "column_null_counts": lambda t: quality.column_null_counts(_exposures(t)),
    "exposure_describe": lambda t: quality.describe_numbers(_exposures(t), ["days_supply", "days_covered"]),
    "exposure_profile": lambda t: quality.exposure_profile(_exposures(t)),
    "latest_exposures": lambda t: quality.latest_exposures(t.drug_exposure),
    "zero_row_diagnosis": lambda t: quality.zero_row_diagnosis(t.drug_exposure, *WINDOW),
    "reversed_dates": lambda t: quality.reversed_dates(t.drug_exposure),
}


def _query(build: Callable[[CdmTables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: plain_types(build(cdm_from_star_schema(spark, folder)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(build) for name, build in BUILDERS.items()}
