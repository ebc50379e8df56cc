"""Coverage operators against the rules applied one fill at a time."""

import random
from datetime import date, timedelta

import brute_force
import pytest
from builders import fills, random_spans
from pyspark.sql import functions as F

from rxcover.operators import coverage, gaps
from rxcover.operators.sequence import sequence_fills

SPANS = random_spans(random.Random(7), 900)


def keyed(df):
    return {(r["person_id"], r["drug_concept_id"]): r.asDict() for r in df.collect()}


@pytest.mark.parametrize(
    ("operator", "expected"),
    [(coverage.merged_totals, brute_force.merged), (coverage.adjusted_totals, brute_force.adjusted)],
)
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_totals_follow_the_rules(spark, operator, expected, seed):
    # few fills per patient-drug, so that gaps, isolated and repeated fills all occur
    spans = random_spans(random.Random(seed), 400, persons=60, drugs=2, reversed_share=0.3)
    found = keyed(operator(fills(spark, spans)))
    wanted = expected(spans)
    assert found.keys() == wanted.keys()
    for key, row in wanted.items():
        assert {name: found[key][name] for name in row} == row, key


def test_periods_follow_the_rules(spark):
    spans = random_spans(random.Random(4), 300, persons=40, reversed_share=0.3)
    found = sorted(
        (r["person_id"], r["drug_concept_id"], r["period_start"], r["period_end"], r["num_fills"])
        for r in coverage.merged_periods(fills(spark, spans)).collect()
    )
    wanted = sorted(
        (*key, *period)
        for key, rows in brute_force.by_patient_drug(spans, lambda r: r).items()
        for period in brute_force.periods(rows)
    )
    assert found == wanted


def test_merge_covers_exactly_the_union_of_days(spark):
    spans = random_spans(random.Random(5), 500, persons=30, reversed_share=0)
    found = keyed(coverage.merged_totals(fills(spark, spans)))
    for key, rows in brute_force.by_patient_drug(spans, lambda r: r).items():
        days = {start + timedelta(n) for start, end, _ in rows for n in range((end - start).days + 1)}
        assert found[key]["total_days_covered"] == len(days)
        assert found[key]["total_days_covered"] + found[key]["total_gap_days"] == found[key]["treatment_duration"]


def test_repeated_reversed_fills_are_periods_of_their_own(spark):
    spans = [(1, 1, 1, "2020-01-01", "2020-01-10")]
    spans += [(1, 1, n, "2020-03-01", "2020-02-01") for n in (2, 3, 4)] + [(1, 1, 5, "2020-06-01", "2020-05-01")]
    frame = fills(spark, spans)
    rows = coverage.coverage_gaps(frame).orderBy("coverage_group").collect()
    assert [(r["coverage_group"], r["num_fills"], r["gap_days"]) for r in rows] == [
        (1, 1, 50), (2, 1, 28), (3, 1, 28), (4, 1, 120), (5, 1, 0)
    ]
    assert keyed(coverage.merged_totals(frame))[1, 1]["total_gap_days"] == 226


@pytest.mark.parametrize("reversed_share", [0, 0.3])
def test_totals_equal_the_sum_over_periods(spark, reversed_share):
    frame = fills(spark, random_spans(random.Random(6), 500, persons=30, reversed_share=reversed_share))
    summed = coverage.coverage_gaps(frame).groupBy("person_id", "drug_concept_id").agg(
        F.sum("days_covered").alias("total_days_covered"),
        F.sum("gap_days").alias("total_gap_days"),
        F.max("gap_days").alias("max_gap_days"),
        F.count("*").alias("num_periods"),
    )
    assert sorted(summed.collect()) == sorted(
        coverage.merged_totals(frame).select(*summed.columns).collect()
    )


def test_lag_covers_at_least_as_much_as_merge(spark):
    frame = fills(spark, random_spans(random.Random(8), 500, persons=30, reversed_share=0))
    lag, merge = keyed(coverage.adjusted_totals(frame)), keyed(coverage.merged_totals(frame))
    assert all(lag[key]["total_days_covered"] >= merge[key]["total_days_covered"] for key in merge)


def test_splitting_a_fill_keeps_merged_days(spark):
    whole = fills(spark, [(1, 1, 1, "2020-01-01", "2020-03-30"), (1, 1, 2, "2020-05-01", "2020-05-30")])
    split = fills(
        spark,
        [
            (1, 1, 1, "2020-01-01", "2020-02-10"),
            (1, 1, 3, "2020-02-11", "2020-03-30"),
            (1, 1, 2, "2020-05-01", "2020-05-30"),
        ],
    )
    days = [keyed(coverage.merged_totals(f))[1, 1]["total_days_covered"] for f in (whole, split)]
    assert days == [120, 120]


def test_row_order_does_not_matter(spark):
    shuffled = random.Random(9).sample(SPANS, len(SPANS))
    for operator in (coverage.merged_totals, coverage.adjusted_totals):
        assert keyed(operator(fills(spark, SPANS))) == keyed(operator(fills(spark, shuffled).repartition(7)))


# from one id per slice to all ids of a day
@pytest.mark.parametrize("slicing", [{"block_bits": 0}, {"block_bits": 6}, {}])
def test_sequence_is_the_same_however_it_is_cut(spark, slicing):
    sequenced = sequence_fills(
        fills(spark, SPANS),
        "fill_sequence",
        following={"next_start_date": "start_date", "next_exposure_id": "drug_exposure_id"},
        **slicing,
    )
    found = {
        r["drug_exposure_id"]: (r["fill_sequence"], r["next_start_date"], r["next_exposure_id"])
        for r in sequenced.collect()
    }
    assert found == brute_force.neighbours(SPANS)


@pytest.mark.parametrize("slicing", [{"block_bits": 0}, {"block_bits": 6}, {}])
def test_adjusted_fills_are_the_same_however_they_are_cut(spark, slicing):
    frame = gaps.adjusted_fills(fills(spark, SPANS), **slicing)
    found = sorted(
        (r["drug_exposure_id"], r["fill_number"], r["prev_end_date"], r["gap_days"], r["overlap_days"])
        + (r["adjusted_days_covered"],)
        for r in frame.collect()
    )
    wanted = sorted(
        step
        for rows in brute_force.by_patient_drug(SPANS, lambda r: r).values()
        for step in brute_force.adjusted_rows(rows)
    )
    assert found == wanted


def test_one_patient_drug_and_one_day_with_most_fills(spark):
    """A third of the fills on one day of one patient-drug, cut by id blocks."""
    spans = [(9, 9, n, date(2020, 5, 5), date(2020, 5, 5 + n % 3)) for n in range(1, 301)]
    spans += [(p, d, 10_000 + n, s, e) for p, d, n, s, e in random_spans(random.Random(11), 500)]
    frame = fills(spark, spans)
    sliced = sequence_fills(
        frame, "n", following={"next_id": "drug_exposure_id"}, block_bits=3
    ).select("drug_exposure_id", "n", "next_id")
    wanted = {key: (value[0], value[2]) for key, value in brute_force.neighbours(spans).items()}
    assert {r[0]: (r[1], r[2]) for r in sliced.collect()} == wanted
    found = keyed(coverage.merged_totals(frame))[9, 9]
    assert (found["total_fills"], found["total_days_covered"]) == (300, 3)


def test_widely_spread_ids(spark):
    """Ids over the whole 64-bit range, negative ones included."""
    draw = random.Random(12)
    ids = list({draw.randrange(-(2**63), 2**63) for _ in range(400)})
    spans = [(1, 1, number, date(2020, 1, 1 + n % 3), date(2020, 2, 1)) for n, number in enumerate(ids)]
    sliced = sequence_fills(fills(spark, spans), "n", following={"next_id": "drug_exposure_id"})
    wanted = {key: (value[0], value[2]) for key, value in brute_force.neighbours(spans).items()}
    assert {r["drug_exposure_id"]: (r["n"], r["next_id"]) for r in sliced.collect()} == wanted


def test_gap_listing_is_the_same_however_it_is_cut(spark):
    frame = fills(spark, SPANS)
    whole = gaps.consecutive_gaps(frame, min_gap_days=0, clamp=True, full=True)
    cut = gaps.consecutive_gaps(frame, min_gap_days=0, clamp=True, full=True, block_bits=4)
    assert sorted(whole.collect(), key=str) == sorted(cut.collect(), key=str)
    assert whole.count() == len(SPANS)


def test_equal_ids_are_ordered_by_the_other_columns(spark):
    """However the rows arrive, fills that share start and id keep one order."""
    spans = [(1, 1, 5, "2020-01-01", f"2020-01-{10 + n}") for n in range(8)] + [(1, 1, 5, "2020-02-01", "2020-02-02")]
    listings = []
    for seed in range(4):
        frame = fills(spark, random.Random(seed).sample(spans, len(spans))).repartition(5)
        listings.append(sorted(gaps.consecutive_gaps(frame, min_gap_days=-100).collect(), key=str))
    assert all(rows == listings[0] for rows in listings)
    ends = {r["fill_sequence"]: r["fill_before_gap_end_date"].day for r in listings[0]}
    assert [ends[n] for n in range(1, 9)] == list(range(10, 18))
