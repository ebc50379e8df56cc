"""Where rows meet and how often: fills are not dealt by drug alone, listings are worked out once."""

import re

import pytest
from builders import WINDOW, tables
from pyspark.sql import functions as F

from rxcover.operators import coverage, exposures, gaps
from rxcover.plans import queries as named


@pytest.fixture
def plain_shuffles(spark):
    """Nothing is broadcast for its size, and no partitions are put together."""
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {key: spark.conf.get(key) for key in changed}
    for key, value in changed.items():
        spark.conf.set(key, value)
    yield
    for key, value in kept.items():
        spark.conf.set(key, value)


@pytest.fixture(scope="module")
def one_drug(spark):
    rows = [{"person": n % 40, "start": f"2020-0{1 + n % 9}-01", "supply": None if n % 3 else 20} for n in range(200)]
    return tables(spark, rows)


def shuffle_keys(plan):
    """The columns of each shuffle, from the last one back."""
    return [re.findall(r"(\w+)#", keys) for keys in re.findall(r"Exchange hashpartitioning\((.*), \d+\)", plan)]


@pytest.mark.parametrize("totals", [coverage.merged_totals, coverage.adjusted_totals])
def test_fills_with_their_median_are_not_dealt_by_drug(one_drug, plain_shuffles, totals):
    """Else the shuffle for the medians would serve the grouping too, with all fills of a drug in one task."""
    fills = exposures.coverage_fills(one_drug.drug_exposure, *WINDOW, impute=True)
    plan = totals(fills)._jdf.queryExecution().executedPlan().toString()
    of_fills, of_medians = plan.split("BroadcastExchange") if "BroadcastExchange" in plan else (plan, "")
    spans = ["person_id", "drug_concept_id", "start_date", "end_date"]
    assert shuffle_keys(of_fills) == [spans[:2], spans]
    assert shuffle_keys(of_medians) == [["drug_concept_id"], ["drug_concept_id", "days_supply"]]
    assert {row["median_days_supply"] for row in fills.select("median_days_supply").distinct().collect()} == {20.0}
    assert totals(fills).agg(F.sum("total_fills")).first()[0] == 200


def test_numbered_fills_with_their_median_are_not_dealt_by_drug(one_drug, plain_shuffles):
    fills = exposures.coverage_fills(one_drug.drug_exposure, *WINDOW, impute=True)
    plan = gaps.adjusted_fills(fills)._jdf.queryExecution().executedPlan().toString()
    of_medians = ["drug_concept_id"]
    assert shuffle_keys(plan).count(of_medians) == plan.count("BroadcastExchange") > 0


@pytest.mark.parametrize("name", ["gaps_detail_ordered", "pdc_merge_ordered", "lag_fill_detail"])
def test_a_listing_is_worked_out_once(spark, name):
    """Places and counts come from one exchange; each shuffle of the rows behind it is written once."""
    found = named.queries()[name](spark, "/root/testdata/sf0.001")
    found.collect()
    final = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan parquet .*lineitem\.parquet", final)) == 1
