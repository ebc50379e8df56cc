"""Small CDM tables for tests."""

from datetime import date, timedelta

from rxcover import schema
from rxcover.sources.cdm import CdmTables

WINDOW = ("2020-01-01", "2021-12-31")


def day(text):
    return date.fromisoformat(text) if isinstance(text, str) else text


def exposures(spark, rows):
    """Fills from dicts; id, person 1, drug 1 and the pharmacy type are filled in."""
    full = [
        (
            row.get("id", number),
            row.get("person", 1),
            row.get("drug", 1),
            day(row.get("start")),
            day(row.get("end")),
            row.get("supply"),
            row.get("refills"),
            row.get("quantity", 1.0),
            row.get("type", 38000175),
        )
        for number, row in enumerate(rows, 1)
    ]
    return spark.createDataFrame(full, schema.DRUG_EXPOSURE)


def fills(spark, spans):
    """Fills with start_date and end_date from (person, drug, id, start, end)."""
    rows = [(p, d, i, day(s), day(e), None, None, 1.0) for p, d, i, s, e in spans]
    return spark.createDataFrame(
        rows,
        "person_id long, drug_concept_id long, drug_exposure_id long, start_date date, end_date date, "
        "days_supply int, refills int, quantity double",
    )


def tables(spark, rows, concepts=((1, "Drug A", "Ingredient", "Drug"),), persons=(), conditions=()):
    return CdmTables.of(
        drug_exposure=exposures(spark, rows),
        concept=spark.createDataFrame(list(concepts), schema.CONCEPT),
        person=spark.createDataFrame(list(persons), schema.PERSON),
        condition_occurrence=spark.createDataFrame(
            [(p, c, day(d)) for p, c, d in conditions], schema.CONDITION_OCCURRENCE
        ),
    )


def random_spans(random, count, persons=6, drugs=2, days=120, reversed_share=0.1):
    """Fills with many shared days, repeated date pairs and some reversed dates."""
    spans = []
    first = date(2020, 1, 1)
    for number in range(count):
        start = first + timedelta(random.randrange(days))
        length = random.choice([1, 2, 5, 10, 30])
        if random.random() < reversed_share:
            length = random.choice([0, -1, -2, -7])
        end = start + timedelta(length - 1)
        spans.append((random.randrange(persons), random.randrange(drugs), number * 7 + 1, start, end))
        if random.random() < 0.2:
            spans.append((*spans[-1][:2], number * 7 + 2, start, end))
    return spans
