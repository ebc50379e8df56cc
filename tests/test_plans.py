"""Properties of the physical plans."""

import re

import pytest
from builders import WINDOW

from rxcover.operators import coverage, exposures
from rxcover.plans import queries as named
from rxcover.sources.cdm import CdmTables
from rxcover.sources.star_schema import cdm_from_star_schema

FOLDER = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The derived CDM tables written out as Parquet."""
    folder = str(tmp_path_factory.mktemp("cdm"))
    tables = cdm_from_star_schema(spark, FOLDER)
    for name in ("drug_exposure", "concept", "person", "condition_occurrence"):
        getattr(tables, name).write.parquet(f"{folder}/{name}")
    return CdmTables.from_parquet(spark, folder)


def test_filters_and_columns_reach_the_scan(stored):
    fills = exposures.coverage_fills(stored.drug_exposure, *WINDOW, dispensed_only=True)
    scan = re.search(r"FileScan parquet.*", physical(coverage.merged_totals(fills))).group()
    assert "GreaterThanOrEqual(drug_exposure_start_date,2020-01-01)" in scan
    assert "In(drug_type_concept_id" in scan
    columns = re.search(r"ReadSchema: struct<(.*)>", scan).group(1)
    assert "quantity" not in columns and "drug_exposure_id" not in columns


@pytest.mark.parametrize("totals", [coverage.merged_totals, coverage.adjusted_totals])
def test_totals_shuffle_counted_spans_only(stored, totals):
    """Fills are counted before the first shuffle; one more serves the windows and the totals."""
    fills = exposures.coverage_fills(stored.drug_exposure, *WINDOW)
    plan = physical(totals(fills))
    exchanges = re.findall(r"Exchange hashpartitioning\((.*), \d+\)", plan)
    keys = [len(re.findall(r"#\d+", exchange)) for exchange in exchanges]
    assert keys == [2, 4]
    first = plan.split("Exchange hashpartitioning")[-1]
    assert "partial_count" in first.splitlines()[1]
    assert plan.count("Window [") == 1


def test_median_supply_is_counted_before_the_shuffle(stored):
    plan = physical(exposures.drug_median_supply(stored.drug_exposure))
    assert plan.index("percentile") < plan.index("partial_count")
    assert "GreaterThan(days_supply,0)" in plan


# Writes its files when it is built.
WRITES = {"pdc_export"}


@pytest.mark.parametrize("name", sorted(named.queries().keys() - WRITES))
def test_no_python_no_cross_join_no_early_sort(spark, name):
    plan = physical(named.queries()[name](spark, FOLDER))
    assert not re.search(r"Python|Pandas|MapIn", plan)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "rangepartitioning" not in plan


def test_building_a_query_starts_no_job(spark):
    """Whatever the size of the tables, and without a checkpoint folder."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "building")
    try:
        for name, build in named.queries().items():
            if name not in WRITES:
                build(spark, FOLDER)
        assert list(tracker.getJobIdsForGroup("building")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def scans(df, table):
    """Scans of a table that run: without the uses of an exchange that another one has filled."""
    df.collect()
    final = physical(df).split("== Initial Plan ==")[0]
    return len(re.findall(rf"FileScan parquet .*{table}\.parquet", final))


# Both sides of the numbering share one exchange in the listings; in the lag detail they do not.
READS = {
    "gaps_detail": 1,
    "gaps_detail_full": 1,
    "gap_by_drug": 1,
    "gap_severity_distribution": 1,
    "gap_totals": 1,
    "top_gap_drugs": 1,
    "lag_fill_detail": 2,
    "headline_report": 1,
    "pdc_by_month": 1,
    "trend_by_drug": 1,
}


@pytest.mark.parametrize("name", sorted(READS))
def test_reads_of_the_fills(spark, name):
    assert scans(named.queries()[name](spark, FOLDER), "lineitem") <= READS[name]
