"""Adherence by calendar cell, gaps counted without a listing, and the headline in one pass."""

import random
import re
from collections import Counter
from datetime import date, timedelta

import brute_force
import pytest
from builders import day, fills, random_spans, tables
from pyspark.sql import functions as F

from rxcover.analysis import AdherenceAnalysis
from rxcover.operators import adherence, coverage, gaps, report, trends

UNITS = {
    "month": lambda d: d.replace(day=1),
    "quarter": lambda d: d.replace(month=(d.month - 1) // 3 * 3 + 1, day=1),
    "year": lambda d: d.replace(month=1, day=1),
}


def plain_cells(spans, unit, min_days):
    """Covered and observed days, one day at a time."""
    cell, out = UNITS[unit], {}
    for key, rows in brute_force.by_patient_drug(spans, lambda r: r).items():
        found = brute_force.periods(rows)
        first, last = min(p[0] for p in found), max(p[1] for p in found)
        if (last - first).days + 1 < min_days:
            continue
        covered, observed = Counter(), Counter()
        for start, end, *_ in found:
            if end < start:
                covered[cell(start)] += (end - start).days + 1
            covered.update(cell(start + timedelta(n)) for n in range((end - start).days + 1))
        observed.update(cell(first + timedelta(n)) for n in range((last - first).days + 1))
        for c in covered.keys() | observed.keys():
            if observed[c] or covered[c]:
                out[(*key, c)] = (covered[c], observed[c])
    return out


@pytest.mark.parametrize(("unit", "seed", "least"), [("month", 1, 30), ("quarter", 2, 1), ("year", 3, -1000)])
def test_cells_follow_the_days(spark, unit, seed, least):
    spans = random_spans(random.Random(seed), 400, persons=60, days=500, reversed_share=0.3)
    rows = trends.calendar_pdc(fills(spark, spans), unit, min_treatment_days=least).collect()
    found = {(r.person_id, r.drug_concept_id, r.period): (r.covered_days, r.observed_days) for r in rows}
    assert len(found) == len(rows)
    assert found == plain_cells(spans, unit, least)


def test_cells_add_up_to_the_totals(spark):
    frame = fills(spark, random_spans(random.Random(4), 600, persons=40, days=700, reversed_share=0.2))
    wanted = {
        (r.person_id, r.drug_concept_id): (r.total_days_covered, max(0, r.treatment_duration))
        for r in coverage.merged_totals(frame).collect()
    }
    cells = trends.calendar_pdc(frame, "month", min_treatment_days=-1000)
    sums = cells.groupBy("person_id", "drug_concept_id").agg(
        F.sum("covered_days").alias("covered"), F.sum("observed_days").alias("observed")
    )
    found = {(r.person_id, r.drug_concept_id): (r.covered, r.observed) for r in sums.collect()}
    assert found == {key: value for key, value in wanted.items() if value != (0, 0)}


def test_a_long_period_is_cut_without_a_row_per_day(spark):
    frame = fills(spark, [(1, 1, 1, "1980-01-15", "2020-03-10")])
    cells = trends.calendar_pdc(frame, "month")
    rows = sorted(cells.collect(), key=lambda r: r.period)
    assert len(rows) == 40 * 12 + 3
    assert (rows[0].covered_days, rows[1].covered_days, rows[-1].covered_days) == (17, 29, 10)
    assert [r.covered_days for r in trends.calendar_pdc(frame, "year").orderBy("period").collect()][:2] == [352, 365]
    cut = [line for line in cells._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in line]
    assert len(cut) == 1 and re.search(r"explode\(sequence\(.*1 months", cut[0])


def test_repeated_reversed_fills_stay_one_row(spark):
    spans = [(1, 1, n, "2020-01-20", "2020-01-10") for n in range(500)] + [(1, 1, 900, "2020-02-01", "2020-03-31")]
    rows = {r.period: (r.covered_days, r.observed_days) for r in trends.calendar_pdc(fills(spark, spans)).collect()}
    assert rows == {date(2020, 1, 1): (-4500, 12), date(2020, 2, 1): (29, 29), date(2020, 3, 1): (31, 31)}


def test_trend_counts_patients_once_and_gives_the_change(spark):
    cells = spark.createDataFrame(
        [
            (1, 1, "A", day("2020-01-01"), 20, 31, 0.6452, "Non-Adherent"),
            (1, 2, "A", day("2020-01-01"), 31, 31, 1.0, "Adherent"),
            (2, 1, None, day("2020-01-01"), 0, 31, 0.0, "Non-Adherent"),
            (2, 1, "A", day("2020-02-01"), 29, 29, 1.0, "Adherent"),
        ],
        "person_id long, drug_concept_id long, drug_name string, period date, covered_days long, observed_days long, "
        "pdc double, adherence_status string",
    )
    overall = trends.adherence_trend(cells).orderBy("period").collect()
    assert [(r.patients, r.combinations, r.pooled_pdc, r.change) for r in overall] == [
        (2, 3, 0.5484, None),
        (1, 1, 1.0, 0.4516),
    ]
    by_drug = trends.adherence_trend(cells, "drug_name").orderBy("period").collect()
    assert [(r.patients, r.combinations, r.pct_adherent, r.mean_pdc) for r in by_drug] == [(1, 2, 50.0, 0.8226), (1, 1, 100.0, 1.0)]


def test_no_fills_give_no_cells(spark):
    empty = fills(spark, [])
    assert trends.adherence_trend(trends.calendar_pdc(empty)).collect() == []
    assert gaps.gap_counts(empty).collect() == []
    assert report.headline_of_fills(empty).collect()[0].asDict() == report.headline_report(
        adherence.patient_drug_pdc(empty), gaps.consecutive_gaps(empty)
    ).collect()[0].asDict()


@pytest.mark.parametrize("clamp", [False, True])
@pytest.mark.parametrize("least", [-40, 0, 7])
def test_counts_are_those_of_the_listing(spark, clamp, least):
    spans = random_spans(random.Random(least + 50), 500, persons=12, days=60, reversed_share=0.4)
    spans = [(p, d, i // 20, s, e) for p, d, i, s, e in spans]  # ids repeat
    frame = fills(spark, spans)
    listed = Counter(
        (r.person_id, r.drug_concept_id, r.gap_days, r.gap_severity)
        for r in gaps.consecutive_gaps(frame, least, clamp).collect()
    )
    counted = gaps.gap_counts(frame, least, clamp).collect()
    assert {(r.person_id, r.drug_concept_id, r.gap_days, r.gap_severity): r.gaps for r in counted} == dict(listed)
    assert len(counted) == len(listed)


@pytest.mark.parametrize("least", [0, 7, 40])
def test_headline_in_one_pass(spark, least):
    frame = fills(spark, random_spans(random.Random(9), 500, persons=50, days=400, reversed_share=0.2))
    pdc, listing = adherence.patient_drug_pdc(frame), gaps.consecutive_gaps(frame, least)
    wanted = report.headline_report(pdc, listing).collect()[0].asDict()
    assert report.headline_of_fills(frame, min_gap_days=least).collect()[0].asDict() == wanted


def test_public_interface(spark):
    analysis = AdherenceAnalysis(
        tables(spark, [{"start": "2020-01-01", "supply": 30}, {"start": "2020-06-01", "supply": 90}]), "merge"
    )
    window = ("2020-01-01", "2020-12-31")
    months = analysis.get_adherence_over_time(*window).orderBy("period").collect()
    assert [(r.drug_name, r.period.month, r.covered_days) for r in months][:2] == [("Drug A", 1, 30), ("Drug A", 2, 0)]
    assert sum(r.covered_days for r in months) == analysis.calculate_pdc(*window).collect()[0].total_days_covered
    assert [(r.gap_days, r.gaps) for r in analysis.get_gap_counts(*window).collect()] == [(122, 1)]
    assert analysis.get_headline(*window).collect()[0].critical_gaps == 1
