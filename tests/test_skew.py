"""Named queries on data where one patient-drug holds a third of all fills."""

import os

import duckdb
import pytest
from compare import TABLES, differences, duckdb_views
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rxcover.operators import exposures, gaps, quality
from rxcover.operators.sequence import BLOCK_BITS, listing_position, sequence_fills
from rxcover.sources.star_schema import WINDOW, cdm_from_star_schema

SOURCE = "/root/testdata/sf0.001"

QUERIES = [
    "gaps_detail_full",
    "gaps_detail_clamped",
    "lag_fill_detail",
    "latest_exposures",
    "merged_periods",
    "coverage_gaps",
    "pdc_merge",
    "pdc_merge_all",
    "pdc_merge_avg_gap",
    "pdc_lag",
    "pdc_lag_enriched",
    "summary_overall",
    "summary_report",
    "drug_summary",
    "notebook_overall",
    "pdc_histogram",
    "drug_median_supply",
    "database_info",
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The star schema with a third of the line items moved to one order and one part."""
    target = str(tmp_path_factory.mktemp("skewed"))
    for table in TABLES:
        if table != "lineitem":
            os.symlink(f"{SOURCE}/{table}.parquet", f"{target}/{table}.parquet")
    duckdb.sql(
        f"""COPY (SELECT * EXCLUDE (file_row_number)
                         REPLACE (CASE WHEN file_row_number % 3 = 0 THEN 100 ELSE l_orderkey END AS l_orderkey,
                                  CASE WHEN file_row_number % 3 = 0 THEN 8 ELSE l_partkey END AS l_partkey)
                  FROM read_parquet('{SOURCE}/lineitem.parquet', file_row_number = true))
            TO '{target}/lineitem.parquet' (FORMAT parquet)"""
    )
    return target


def test_the_data_is_skewed(spark, folder):
    fills = cdm_from_star_schema(spark, folder).drug_exposure
    largest = fills.groupBy("person_id", "drug_concept_id").count().agg({"count": "max"}).first()[0]
    assert largest >= fills.count() / 3


@pytest.mark.parametrize("name", QUERIES)
def test_results_on_skewed_data(spark, folder, name):
    df = entry.queries()[name](spark, folder)
    assert differences(df, duckdb_views(folder), entry.oracle_sql()[name]) == []


def test_block_size_does_not_show(spark, folder):
    fills = exposures.coverage_fills(cdm_from_star_schema(spark, folder).drug_exposure, *WINDOW)
    whole = gaps.consecutive_gaps(fills, min_gap_days=0, clamp=True, full=True)
    cut = gaps.consecutive_gaps(fills, min_gap_days=0, clamp=True, full=True, block_bits=4)
    assert sorted(whole.collect(), key=str) == sorted(cut.collect(), key=str)


LARGE = [
    "exposures_base", "exposures_coverage", "exposures_imputed", "recent_exposures", "lag_fill_detail", "gaps_detail",
    "gaps_detail_full", "gaps_detail_clamped", "gaps_detail_imputed", "gap_by_drug", "gap_severity_distribution",
    "gap_totals", "top_gap_drugs", "headline_report", "column_null_counts", "latest_exposures",
]


@pytest.fixture(scope="module")
def large_keys(tmp_path_factory):
    """The star schema with order keys from 1.2e9 and part keys from 100,000 on."""
    target = str(tmp_path_factory.mktemp("large"))
    changed = {
        "lineitem": "l_orderkey + 1200000000 AS l_orderkey, l_partkey + 100000 AS l_partkey",
        "orders": "o_orderkey + 1200000000 AS o_orderkey",
        "part": "p_partkey + 100000 AS p_partkey",
    }
    for table in TABLES:
        if table in changed:
            duckdb.sql(
                f"""COPY (SELECT * REPLACE ({changed[table]}) FROM '{SOURCE}/{table}.parquet')
                    TO '{target}/{table}.parquet' (FORMAT parquet)"""
            )
        else:
            os.symlink(f"{SOURCE}/{table}.parquet", f"{target}/{table}.parquet")
    return target


@pytest.mark.parametrize("name", LARGE)
def test_large_keys(spark, large_keys, name):
    df = entry.queries()[name](spark, large_keys)
    assert differences(df, duckdb_views(large_keys), entry.oracle_sql()[name]) == []


def test_spread_ids_of_a_frequent_patient_drug(spark):
    """Ids over 2**60 and a third of the fills in one patient-drug: same rows as plain windows, small groups on each level."""
    count = 60_000
    frame = spark.range(count).selectExpr(
        "IF(id % 3 = 0, 1, id % 5000 + 2) AS person_id",
        "CAST(1 AS LONG) AS drug_concept_id",
        "shiftright(xxhash64(id), 4) AS drug_exposure_id",
        "date_add(DATE '2020-01-01', CAST(pmod(xxhash64(id, 1), 300) AS INT)) AS start_date",
        "date_add(DATE '2020-01-01', CAST(pmod(xxhash64(id, 2), 400) AS INT)) AS end_date",
    )
    order = Window.partitionBy("person_id", "drug_concept_id").orderBy("start_date", "end_date", "drug_exposure_id")
    wanted = frame.select(
        "*",
        F.row_number().over(order).cast("long").alias("n"),
        F.lag("end_date").over(order).alias("before"),
        F.lead("drug_exposure_id").over(order).alias("after"),
    )
    found = sequence_fills(frame, "n", True, {"before": "end_date"}, {"after": "drug_exposure_id"})
    assert found.count() == count
    assert found.exceptAll(wanted.select(found.columns)).isEmpty()
    region, block = (F.shiftright("drug_exposure_id", bits * BLOCK_BITS) for bits in (2, 1))
    levels = [["person_id"], ["person_id", "start_date"], ["person_id", "start_date", "end_date", region]]
    children = [["start_date"], ["end_date", region], [block]]
    for above, below in zip(levels, children):
        largest = frame.groupBy(*above).agg(F.count_distinct(*below).alias("rows")).agg(F.max("rows")).first()[0]
        assert largest <= 300  # of 20,000 fills of the patient-drug


@pytest.mark.parametrize("bits", [2, 21])
def test_positions_in_a_listing(spark, bits):
    """A third of the rows in one person, negative and very large ids, and no window over all rows."""
    frame = spark.range(3000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN -id ELSE id << 40 END AS person_id", "id % 1000 AS drug", "id AS rest"
    )
    everything = Window.orderBy("person_id", "drug", "rest")
    wanted = frame.withColumn("position", F.row_number().over(everything).cast("long"))
    found = listing_position(frame, ["person_id", "drug", "rest"], block_bits=bits)
    assert found.columns == wanted.columns and found.count() == 3000
    assert found.exceptAll(wanted).isEmpty()
    assert listing_position(frame.limit(0), ["person_id", "drug"]).collect() == []


@pytest.mark.parametrize("bits", [3, 21])
def test_quartiles_of_a_wide_column(spark, bits):
    """Exact, with as many distinct values as rows, a third of the rows on one value, negative and large ones."""
    frame = spark.range(20_000).selectExpr(
        "IF(id % 3 = 0, 5, shiftright(xxhash64(id), 20)) AS wide", "IF(id % 7 = 0, NULL, id % 11) AS narrow", "CAST(NULL AS LONG) AS none", "id AS own"
    )
    columns = frame.columns
    found = {r["column_name"]: r for r in quality.describe_numbers(frame, columns, bits).collect()}
    for name in columns:
        wanted = frame.agg(F.percentile(name, [0.25, 0.5, 0.75]).alias("q"), F.count(name).alias("n")).first()
        row = found[name]
        assert row["count"] == wanted["n"]
        assert [row["q25"], row["q50"], row["q75"]] == pytest.approx(wanted["q"]) if wanted["n"] else row["q50"] is None
    empty = quality.describe_numbers(frame.limit(0), columns, bits).collect()
    assert all(r["count"] == 0 for r in empty)
