"""Reading tables and writing results."""

from datetime import datetime
from pathlib import Path

import pytest
from builders import WINDOW, exposures, tables

from rxcover import AdherenceAnalysis, CdmTables, schema
from rxcover.functions.ratios import plain_types
from rxcover.operators.coverage import merged_totals
from rxcover.operators.exposures import coverage_fills
from rxcover.operators.summary import drug_summary
from rxcover.sources.cdm import conform
from rxcover.sources.layout import bucket_rows, store_fills
from rxcover.sources.sinks import IncompleteExport, export_csv, read_export

ROWS = [{"start": "2020-01-01", "supply": 60}, {"start": "2020-05-01", "supply": 30}]


def test_catalog_tables_in_any_case(spark):
    source = tables(spark, ROWS, persons=[(1, 1960)])
    spark.sql("CREATE DATABASE IF NOT EXISTS claims")
    for name in ("drug_exposure", "concept", "person", "condition_occurrence"):
        frame = getattr(source, name)
        frame.toDF(*[c.upper() for c in frame.columns]).write.mode("overwrite").saveAsTable(f"claims.{name.upper()}")
    stored = CdmTables.from_catalog(spark, "claims")
    assert stored.drug_exposure.columns == source.drug_exposure.columns
    found = AdherenceAnalysis(stored).calculate_pdc(*WINDOW).first()
    assert (found.drug_name, found.total_days_covered, found.treatment_duration) == ("Drug A", 90, 151)


def test_csv_export(spark, tmp_path):
    analysis = AdherenceAnalysis(tables(spark, ROWS))
    pdc, gaps = analysis.calculate_pdc(*WINDOW), analysis.get_detailed_gaps(*WINDOW)
    at = datetime(2024, 1, 2, 3, 4, 5)
    written = export_csv(str(tmp_path), at, pdc=pdc, drug_summary=drug_summary(pdc), gaps=gaps)
    assert written["pdc"].endswith("pdc_results_20240102_030405.csv")
    assert written["drug_summary"].endswith("drug_summary_20240102_030405.csv")
    assert written["gaps"].endswith("gap_details_20240102_030405.csv")
    back = spark.read.option("header", True).csv(written["drug_summary"])
    assert back.columns[0] == "drug_name" and back.first().drug_name == "Drug A"
    assert spark.read.option("header", True).csv(written["gaps"]).first().gap_days == "61"
    assert spark.read.option("header", True).csv(written["pdc"]).columns == pdc.columns


def test_csv_export_is_in_order(spark, tmp_path):
    rows = [{"person": p, "drug": d, "start": "2020-01-01", "supply": 60} for p in (3, 1, 2) for d in (2, 1)]
    pdc = AdherenceAnalysis(tables(spark, rows)).calculate_pdc(*WINDOW)
    written = export_csv(str(tmp_path), pdc=pdc)
    back = spark.read.option("header", True).csv(written["pdc"]).select("person_id", "drug_concept_id").collect()
    assert [tuple(r) for r in back] == [(p, d) for p in "123" for d in "12"]


def test_bucketed_fills_need_no_shuffle(spark):
    """Fills stored in buckets of patient and drug give PDC without any exchange."""
    source = tables(spark, ROWS).drug_exposure
    spark.sql("CREATE DATABASE IF NOT EXISTS claims")
    writer = source.write.mode("overwrite").bucketBy(4, "person_id", "drug_concept_id")
    writer.saveAsTable("claims.bucketed_exposure")
    stored = conform(spark.table("claims.bucketed_exposure"), schema.DRUG_EXPOSURE)
    totals = merged_totals(coverage_fills(stored, *WINDOW))
    assert "Exchange" not in totals._jdf.queryExecution().executedPlan().toString()
    assert totals.first().total_days_covered == 90


def test_plain_types(spark):
    frame = spark.sql("SELECT CAST(1.5 AS DECIMAL(10,4)) AS a, 1 AS b, 'x' AS c, DATE '2020-01-01' AS d")
    assert [kind for _, kind in plain_types(frame).dtypes] == ["double", "bigint", "string", "date"]


def exported(spark, folder):
    analysis = AdherenceAnalysis(tables(spark, [*ROWS, {"person": 2, "drug": 9, "start": "2020-01-01", "supply": 60}]))
    pdc, gaps = analysis.calculate_pdc(*WINDOW), analysis.get_detailed_gaps(*WINDOW)
    export_csv(folder, datetime(2024, 1, 2, 3, 4, 5), pdc=pdc, gaps=gaps)
    return pdc, gaps


def test_export_is_read_back_with_its_types(spark, tmp_path):
    pdc, gaps = exported(spark, str(tmp_path))
    back = read_export(spark, str(tmp_path), "20240102_030405")
    assert back.keys() == {"pdc", "gaps"}
    for name, frame in (("pdc", pdc), ("gaps", gaps)):
        assert back[name].dtypes == frame.dtypes
        assert sorted(map(str, back[name].collect())) == sorted(map(str, frame.collect()))


@pytest.mark.parametrize("change", ["cut", "append", "remove", "replace"])
def test_a_changed_export_is_refused(spark, tmp_path, change):
    exported(spark, str(tmp_path))
    part = next(p for p in Path(tmp_path, "pdc_results_20240102_030405.csv").glob("part-*") if p.stat().st_size)
    lines = part.read_text().splitlines(keepends=True)
    part.with_name(f".{part.name}.crc").unlink()  # as after a copy by other means
    if change == "remove":
        part.unlink()
    else:
        new = {"cut": lines[:-1], "append": [*lines, lines[-1]], "replace": [*lines[:-1], lines[-1].replace("1", "7")]}
        part.write_text("".join(new[change]))
    with pytest.raises(IncompleteExport):
        read_export(spark, str(tmp_path))


def test_an_export_without_manifest_is_refused(spark, tmp_path):
    pdc, _ = exported(spark, str(tmp_path))
    with pytest.raises(IncompleteExport):
        read_export(spark, str(tmp_path), "20990101_000000")


def test_stored_buckets(spark):
    """Few files, sorted, read without an exchange; the size of a frequent patient-drug's bucket shows beforehand."""
    spark.sql("CREATE DATABASE IF NOT EXISTS claims")
    rows = [{"person": 1 if n % 3 == 0 else n, "drug": n % 2, "start": "2020-01-01", "supply": 60} for n in range(300)]
    rows = [{**r, "drug": 1 if r["person"] == 1 else r["drug"]} for r in rows]
    source = exposures(spark, rows)
    stored = store_fills(source, "claims.stored_exposure", 4, files=2)
    assert len(stored.inputFiles()) <= 8
    assert sorted(map(str, stored.collect())) == sorted(map(str, source.collect()))
    totals = merged_totals(coverage_fills(stored, *WINDOW))
    assert "Exchange" not in totals._jdf.queryExecution().executedPlan().toString()
    wanted = merged_totals(coverage_fills(source, *WINDOW))
    assert sorted(map(str, totals.collect())) == sorted(map(str, wanted.collect()))
    sizes = bucket_rows(source, 4).collect()
    assert sum(r.rows for r in sizes) == 300 and len(sizes) == 4
    assert max(r.times_mean for r in sizes) > 1.6
    assert sum(r.rows for r in bucket_rows(source.limit(0), 4).collect()) == 0
