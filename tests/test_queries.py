"""Every named query against its SQL, and the known counts of the derived data."""

import os

import pytest
from compare import differences, duckdb_views
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rxcover.plans import oracle
from rxcover.plans import queries as named

FOLDER = os.environ.get("RXCOVER_TEST_DATA", "/root/testdata/sf0.001")
COUNTED = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def views():
    return duckdb_views(FOLDER)


def test_every_query_has_sql():
    assert named.queries().keys() == oracle.oracle_sql().keys()
    assert named.queries().keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", sorted(named.queries()))
def test_query_equals_sql(spark, views, name):
    df = entry.queries()[name](spark, FOLDER)
    assert set(dict(df.dtypes).values()) <= {"bigint", "double", "date", "string"}
    assert differences(df, views, entry.oracle_sql()[name]) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0


# Known counts of the derived tables and results at the 0.01 scale.
STATUS_COUNTS = {
    "pdc_merge": (2192, 758, 8587),
    "pdc_merge_all": (1869, 937, 8934),
    "pdc_lag": (2099, 971, 8670),
}
SEVERITY_COUNTS = {
    "gaps_detail": (11434, 7449, 2679, 1296),
    "gaps_detail_imputed": (10765, 8009, 3021, 1427),
}


@pytest.mark.parametrize("name", sorted(STATUS_COUNTS))
def test_status_counts(spark, name):
    counts = {r[0]: r[1] for r in entry.queries()[name](spark, COUNTED).groupBy("adherence_status").count().collect()}
    labels = ("Adherent", "Moderately Adherent", "Non-Adherent")
    assert tuple(counts[label] for label in labels) == STATUS_COUNTS[name]


@pytest.mark.parametrize("name", sorted(SEVERITY_COUNTS))
def test_severity_counts(spark, name):
    frame = entry.queries()[name](spark, COUNTED).groupBy(F.split("gap_severity", " ")[0]).count()
    counts = {r[0]: r[1] for r in frame.collect()}
    assert tuple(counts[label] for label in ("Critical", "Major", "Moderate", "Minor")) == SEVERITY_COUNTS[name]


def test_imputation_counts(spark):
    frame = entry.queries()["exposures_imputed"](spark, COUNTED).groupBy("imputation_method").count()
    assert {r[0]: r[1] for r in frame.collect()} == {
        "actual_end_date": 8590,
        "days_supply": 14950,
        "refills": 13698,
        "drug_median": 17163,
        "default_30": 4645,
    }


def test_enriched_counts(spark):
    row = entry.queries()["pdc_lag_enriched"](spark, COUNTED).agg(
        F.count("*"),
        F.count_if(F.col("age").isNull()),
        F.count_if(F.col("primary_condition") == "No Condition Recorded"),
        F.max("pdc"),
    )
    assert tuple(row.first()) == (7347, 180, 29, 1.0)


def test_bin_counts(spark):
    report = entry.queries()["summary_report"](spark, COUNTED).filter("category = 'PDC Distribution'")
    left = {r.subcategory: r.total_patient_drug_combinations for r in report.collect()}
    right = {r.pdc_bin: r.combinations for r in entry.queries()["summary_distribution_cut"](spark, COUNTED).collect()}
    labels = ("90-100%", "80-89%", "70-79%", "60-69%", "50-59%", "<50%")
    assert [left[label] for label in labels] == [1768, 424, 758, 1275, 1701, 5611]
    assert [right[label] for label in labels] == [1764, 425, 760, 1259, 1695, 5628]


def test_high_risk_count(spark):
    assert entry.queries()["high_risk_patients"](spark, COUNTED).count() == 7967


def test_rare_rules_occur(spark):
    """Reversed dates, missing starts, names and PDC below 0 are in the derived data."""
    value = lambda name, column: entry.queries()[name](spark, COUNTED).first()[column]
    assert value("reversed_dates", "reversed_dates") > 0
    assert value("null_profile", "null_start_dates") > 0
    assert entry.queries()["pdc_merge"](spark, COUNTED).filter("drug_concept_id = 4 AND drug_name IS NULL").count() > 0
    assert entry.queries()["pdc_merge"](spark, COUNTED).filter("pdc < 0").count() > 0
    assert entry.queries()["pdc_lag_enriched"](spark, COUNTED).filter("pdc = 0").count() > 0
