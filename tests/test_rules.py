"""Hand-made cases for each rule and boundary."""

from datetime import date
from decimal import Decimal

import pytest
from builders import WINDOW, exposures, fills, tables
from pyspark.sql import functions as F

from rxcover import PROFILES, AdherenceAnalysis
from rxcover.analysis import get_date_range
from rxcover.functions.classify import adherence_status, gap_severity, pdc_bin, pdc_bins_right_closed, pdc_units
from rxcover.operators import enrich, quality, summary
from rxcover.operators import exposures as listing
from rxcover.operators.adherence import patient_drug_pdc
from rxcover.operators.gaps import consecutive_gaps


def only(df):
    (row,) = df.collect()
    return row


CONTAINED = [
    (1, 1, 1, "2020-01-01", "2020-04-09"),
    (1, 1, 2, "2020-01-10", "2020-01-20"),
    (1, 1, 3, "2020-02-19", "2020-02-29"),
]


def test_contained_fills(spark):
    merge = only(patient_drug_pdc(fills(spark, CONTAINED)))
    assert (merge.num_periods, merge.total_days_covered, merge.num_gaps, merge.pdc) == (1, 100, 0, 1.0)
    lag = only(patient_drug_pdc(fills(spark, CONTAINED), "lag"))
    assert (lag.total_days_covered, lag.total_gap_days, lag.treatment_duration, lag.pdc) == (111, 29, 100, 1.11)
    capped = only(patient_drug_pdc(fills(spark, CONTAINED), "lag", cap=True))
    assert (capped.pdc, capped.adherence_status) == (1.0, "Adherent")


@pytest.mark.parametrize(("next_start", "periods", "gap"), [("2020-01-31", 1, 0), ("2020-02-01", 2, 1)])
def test_adjacent_fills(spark, next_start, periods, gap):
    spans = [(1, 1, 1, "2020-01-01", "2020-01-30"), (1, 1, 2, next_start, "2020-03-01")]
    merge = only(patient_drug_pdc(fills(spark, spans)))
    assert (merge.num_periods, merge.total_gap_days) == (periods, gap)
    assert only(patient_drug_pdc(fills(spark, spans), "lag")).total_gap_days == gap


def test_end_date_ladder(spark):
    rows = [
        {"start": "2020-01-01", "end": "2020-01-10"},
        {"start": "2020-01-01", "supply": 15},
        {"start": "2020-01-01", "refills": 2},
        {"start": "2020-01-01"},
        {"start": "2020-01-01", "supply": 0, "refills": 1},
        {"start": "2020-01-01", "end": "2019-12-27"},
    ]
    found = listing.drug_exposures(exposures(spark, rows), *WINDOW).orderBy("drug_exposure_id").collect()
    assert [(str(r.calculated_end_date), r.days_covered) for r in found] == [
        ("2020-01-10", 10),
        ("2020-01-15", 15),
        ("2020-02-29", 60),
        ("2020-01-30", 30),
        ("2020-01-30", 30),
        ("2019-12-27", -4),
    ]


def test_imputation(spark):
    rows = [
        {"start": "2020-01-01", "supply": 15},
        {"start": "2018-01-01", "supply": 30, "type": 1},  # counts for the median, outside the window
        {"start": "2020-01-01"},
        {"start": "2020-01-01", "drug": 2, "supply": 0, "refills": 0},
        {"start": "2020-01-01", "refills": 1},
        {"start": "2020-01-01", "end": "2020-01-05"},
    ]
    found = listing.drug_exposures(exposures(spark, rows), *WINDOW, impute=True).orderBy("drug_exposure_id").collect()
    assert [(r.drug_exposure_id, r.imputation_method, str(r.calculated_end_date), r.days_covered) for r in found] == [
        (1, "days_supply", "2020-01-15", 15.0),
        (3, "drug_median", "2020-01-22", 22.5),
        (4, "default_30", "2020-01-30", 30.0),
        (5, "refills", "2020-01-30", 30.0),
        (6, "actual_end_date", "2020-01-05", 5.0),
    ]
    assert [r.median_days_supply for r in found] == [22.5, 22.5, None, 22.5, 22.5]


def test_window_and_type_filter(spark):
    rows = [
        {"start": "2019-12-31"},
        {"start": "2020-01-01"},
        {"start": "2021-12-31", "type": 38000180},
        {"start": "2022-01-01"},
        {"start": None},
    ]
    frame = exposures(spark, rows)
    assert [r.drug_exposure_id for r in listing.in_window(frame, *WINDOW).collect()] == [2, 3]
    assert [r.drug_exposure_id for r in listing.in_window(frame, *WINDOW, dispensed_only=True).collect()] == [2]


def test_limit_follows_the_listing_order(spark):
    rows = [
        {"id": 5, "start": "2020-03-01"},
        {"id": 4, "start": "2020-02-01"},
        {"id": 3, "start": "2020-02-01"},
        {"id": 2, "person": 2, "start": "2020-01-01"},
    ]
    found = AdherenceAnalysis(tables(spark, rows)).get_drug_exposures(*WINDOW, limit=2)
    assert [r.drug_exposure_id for r in found.collect()] == [3, 4]


def test_recent_exposures(spark):
    rows = [{"start": d} for d in ("2021-06-30", "2021-07-01", "2021-12-28", "2021-12-29")]
    recent = listing.recent_exposures(exposures(spark, rows), 6, "2021-12-28")
    assert sorted(r.drug_exposure_id for r in recent.collect()) == [2, 3]
    assert get_date_range(6, date(2021, 12, 28)) == ("2021-07-01", "2021-12-28")


def test_reversed_dates(spark):
    spans = [(1, 1, 1, "2020-01-10", "2020-01-05")]
    row = only(patient_drug_pdc(fills(spark, spans), min_treatment_days=-10))
    assert (row.total_days_covered, row.treatment_duration, row.pdc) == (-4, -4, 0.0)
    assert patient_drug_pdc(fills(spark, spans)).count() == 0
    assert only(quality.reversed_dates(exposures(spark, [{"start": "2020-01-10", "end": "2020-01-05"}]))) == (1, 1)


def test_exact_moderate_boundary(spark):
    spans = [(1, 1, 1, "2020-01-01", "2020-01-20"), (1, 1, 2, "2020-01-30", "2020-01-30")]
    row = only(patient_drug_pdc(fills(spark, spans), threshold=0.80))
    assert (row.total_days_covered, row.treatment_duration, row.pdc) == (21, 30, 0.7)
    assert row.adherence_status == "Moderately Adherent"


@pytest.mark.parametrize(
    ("value", "status"),
    [("0.8000", "Adherent"), ("0.7999", "Moderately Adherent"), ("0.7000", "Moderately Adherent")]
    + [("0.6999", "Non-Adherent"), ("1.1100", "Adherent")],
)
def test_status(spark, value, status):
    frame = spark.range(1).select(adherence_status(F.lit(Decimal(value))).alias("s"))
    assert only(frame).s == status


def test_bins(spark):
    frame = spark.createDataFrame([(v,) for v in (0.0, 0.5, 0.8, 0.9, 1.0, 1.11)], "pdc double")
    units = pdc_units(F.col("pdc"))
    tests = pdc_bins_right_closed(units)
    right = F.coalesce(*[F.when(test, name) for name, test in tests.items()])
    found = frame.select(pdc_bin(units).alias("left"), right.alias("right")).collect()
    assert [r.left for r in found] == ["<50%", "50-59%", "80-89%", "90-100%", "90-100%", "90-100%"]
    assert [r.right for r in found] == [None, "<50%", "70-79%", "80-89%", "90-100%", None]


def test_severity(spark):
    days = spark.createDataFrame([(d,) for d in (6, 7, 13, 14, 29, 30, 89, 90)], "d int")
    names = [r.s.split()[0] for r in days.select(gap_severity(F.col("d")).alias("s")).collect()]
    assert names == ["Minimal", "Minor", "Minor", "Moderate", "Moderate", "Major", "Major", "Critical"]


def test_gap_listing(spark):
    spans = [
        (1, 1, 2, "2020-01-01", "2020-01-10"),
        (1, 1, 1, "2020-01-01", "2020-01-20"),
        (1, 1, 3, "2020-02-01", "2020-02-10"),
    ]
    signed = consecutive_gaps(fills(spark, spans), min_gap_days=-100, full=True).orderBy("fill_sequence").collect()
    assert [(r.fill_before_gap_id, r.fill_sequence, r.gap_days, r.fill_after_gap_id) for r in signed] == [
        (1, 1, -20, 2),
        (2, 2, 21, 3),
    ]
    assert (str(signed[1].gap_start_date), str(signed[1].gap_end_date)) == ("2020-01-11", "2020-01-31")
    clamped = consecutive_gaps(fills(spark, spans), min_gap_days=0, clamp=True).orderBy("fill_sequence").collect()
    assert [(r.gap_days, r.gap_end_date is None) for r in clamped] == [(0, False), (21, False), (0, True)]


def test_primary_condition_tie(spark):
    counts = spark.createDataFrame(
        [(1, 20, "B", 2), (1, 10, "A", 2), (1, 30, "C", 1), (2, 30, "C", 1)],
        "person_id long, condition_concept_id long, concept_name string, occurrence_count long",
    )
    found = enrich.condition_summary(counts).orderBy("person_id").collect()
    assert [tuple(r) for r in found] == [(1, 3, "A"), (2, 1, "C")]


@pytest.fixture
def two_drugs(spark):
    rows = [
        {"start": "2020-01-01", "supply": 90},
        {"start": "2020-06-01", "supply": 30},
        {"start": "2020-01-01", "supply": 90, "drug": 2},
        {"start": "2020-01-01", "supply": 90, "drug": 3, "person": 2},
    ]
    concepts = [
        (1, "Drug A", "Ingredient", "Drug"),
        (3, "Drug C", "Device", "Device"),
        (10, "Asthma", "Clinical Finding", "Condition"),
        (11, "Height", "Clinical Finding", "Observation"),
    ]
    conditions = [(1, 10, "2000-01-01"), (1, 10, "2021-12-31"), (1, 10, "2022-01-01"), (1, 11, "2020-01-01")]
    return tables(spark, rows, concepts, [(1, 1960)], conditions)


def test_unmapped_drugs(two_drugs):
    named = AdherenceAnalysis(two_drugs).calculate_pdc(*WINDOW)
    names = sorted((r.drug_concept_id, r.drug_name) for r in named.collect())
    assert names == [(1, "Drug A"), (2, None), (3, "Drug C")]
    assert [r.drug_name for r in summary.summary_by_drug(named).orderBy("drug_name").collect()] == ["Drug A", "Drug C"]
    report = summary.summary_report(named, min_patients=1)
    assert {r.subcategory for r in report.collect() if r.category == "By Drug"} == {"Drug A", "Drug C", None}


def test_enriched(two_drugs):
    analysis = AdherenceAnalysis(two_drugs, "enriched")
    row = only(analysis.calculate_pdc(*WINDOW, as_of="2021-12-31"))
    assert (row.drug_name, row.age, row.primary_condition, row.comorbidity_count) == ("Drug A", 61, "Asthma", 1)
    kept = analysis.calculate_pdc(*WINDOW, as_of="2021-12-31", keep_unmapped=True).orderBy("drug_concept_id").collect()
    assert [(r.drug_name, r.age, r.primary_condition, r.comorbidity_count) for r in kept] == [
        ("Drug A", 61, "Asthma", 1),
        ("Unknown Drug", 61, "Asthma", 1),
        ("Unknown Drug", None, "No Condition Recorded", 0),
    ]


def test_summary_statistics(two_drugs):
    parts = AdherenceAnalysis(two_drugs).get_summary_statistics(*WINDOW)
    overall = only(parts["overall"])
    assert (overall.total_patients, overall.total_patient_drug_combinations, overall.adherent_count) == (2, 3, 2)
    assert overall.avg_pdc == pytest.approx((120 / 182 * 1 + 2) / 3, abs=1e-4)
    bins = {r.pdc_bin: r.combinations for r in parts["pdc_distribution"].collect()}
    assert bins == {"<50%": 0, "50-59%": 0, "60-69%": 1, "70-79%": 0, "80-89%": 0, "90-100%": 2}
    assert parts["full_data"].count() == 3
    parts["full_data"].unpersist()


def test_report_columns_are_not_swapped(two_drugs):
    report = summary.summary_report(AdherenceAnalysis(two_drugs).calculate_pdc(*WINDOW), 1)
    rows = report.collect()
    assert all(r.unique_patients <= r.total_patient_drug_combinations for r in rows)
    first = summary.in_report_order(report).first()
    assert (first.category, first.unique_patients, first.total_patient_drug_combinations) == ("Overall", 2, 3)


def test_histogram_of_one_value(two_drugs):
    pdc = AdherenceAnalysis(two_drugs).calculate_pdc(*WINDOW).filter("pdc = 1")
    bins = summary.pdc_histogram(pdc).orderBy("bin").collect()
    assert len(bins) == 50
    assert [(r.bin, r.combinations) for r in bins if r.combinations] == [(25, 2)]
    assert (bins[0].lower_edge, bins[49].upper_edge) == (0.5, 1.5)


def test_diagnosis(spark):
    frame = exposures(spark, [{"start": "2020-01-01", "type": 1}])
    verdicts = [only(quality.zero_row_diagnosis(frame, *w)).verdict for w in (("2030-01-01", "2030-12-31"), WINDOW)]
    assert verdicts == ["no records in date range", "drug type filter excludes all records"]
    frame = exposures(spark, [{"start": "2020-01-01"}])
    assert only(quality.zero_row_diagnosis(frame, *WINDOW)).verdict == "query should return rows"


def test_describe(spark):
    frame = spark.createDataFrame([(1,), (2,), (4,), (None,)], "v int")
    row = only(quality.describe_numbers(frame, ["v"]))
    assert (row["count"], row["min"], row.q25, row.q50, row.q75, row["max"]) == (3, 1.0, 1.5, 2.0, 3.0, 4.0)
    assert row["mean"] == pytest.approx(7 / 3)


@pytest.mark.parametrize("profile", sorted(PROFILES))
def test_empty_input(spark, profile):
    analysis = AdherenceAnalysis(tables(spark, []), profile)
    pdc, gaps = analysis.calculate_pdc(*WINDOW), analysis.get_detailed_gaps(*WINDOW)
    assert (pdc.count(), gaps.count(), analysis.get_drug_exposures(*WINDOW).count()) == (0, 0, 0)
    assert only(analysis.get_database_info()).total_drug_exposures == 0
    assert only(analysis.get_days_supply_null_stats()).pct_null is None
    assert only(analysis.get_actual_date_range()).start_date is None
    assert only(summary.summary_overall(pdc)).adherent_percentage is None
    overall = only(summary.summary_report(pdc))
    assert (overall.category, overall.unique_patients, overall.pct_adherent) == ("Overall", 0, None)
    assert summary.pdc_histogram(pdc).count() == 0
    assert summary.gap_by_drug(gaps).count() == 0
