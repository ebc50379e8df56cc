"""Column expressions for fill end dates, days covered and gaps between fills."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from rxcover.schema import DAYS_PER_REFILL, DEFAULT_SUPPLY_DAYS


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier).cast("bigint")


def _ladder(end: Column, supply: Column, refills: Column, median: Column | None, values: dict) -> Column:
    """First usable source of a fill's length, as `values[source]`."""
    rungs = F.when(end.isNotNull(), values["actual_end_date"])
    rungs = rungs.when(supply > 0, values["days_supply"])
    rungs = rungs.when(refills > 0, values["refills"])
    if median is not None:
        rungs = rungs.when(median.isNotNull(), values["drug_median"])
    return rungs.otherwise(values["default_30"])


def coverage_end(start: Column, end: Column, supply: Column, refills: Column, median: Column | None = None) -> Column:
    """Last covered day. A recorded end date wins even if it precedes the start."""
    values = {
        "actual_end_date": end,
        "days_supply": F.date_add(start, supply - 1),
        "refills": F.date_add(start, refills * DAYS_PER_REFILL - 1),
        "default_30": F.date_add(start, DEFAULT_SUPPLY_DAYS - 1),
    }
    if median is not None:
        values["drug_median"] = F.date_add(start, F.floor(median).cast("int") - 1)
    return _ladder(end, supply, refills, median, values)


def days_covered(start: Column, end: Column, supply: Column, refills: Column, median: Column | None = None) -> Column:
    """Days the fill covers; with a median the unrounded median counts (so x.5 occurs)."""
    kind = "bigint" if median is None else "double"
    values = {
        "actual_end_date": (days_between(end, start) + 1).cast(kind),
        "days_supply": supply.cast(kind),
        "refills": (refills.cast("bigint") * DAYS_PER_REFILL).cast(kind),
        "default_30": F.lit(DEFAULT_SUPPLY_DAYS).cast(kind),
    }
    if median is not None:
        values["drug_median"] = median
    return _ladder(end, supply, refills, median, values)


def effective_supply(supply: Column, refills: Column, median: Column | None = None) -> Column:
    """Days of supply with the same fallbacks, ignoring any recorded end date."""
    no_end = F.lit(None).cast("date")
    return days_covered(no_end, no_end, supply, refills, median)


def imputation_method(end: Column, supply: Column, refills: Column, median: Column) -> Column:
    names = ("actual_end_date", "days_supply", "refills", "drug_median", "default_30")
    return _ladder(end, supply, refills, median, {name: F.lit(name) for name in names})


def gap_after(end: Column, following_start: Column) -> Column:
    """Uncovered days up to the next start; negative on overlap, NULL at the end."""
    return days_between(following_start, end) - 1


def gap_since(start: Column, previous_end: Column) -> Column:
    """Uncovered days since the previous fill ended, 0 if there is none."""
    return F.when(start > previous_end, days_between(start, previous_end) - 1).otherwise(F.lit(0).cast("bigint"))


def overlap_with(start: Column, previous_end: Column) -> Column:
    return F.when(start <= previous_end, days_between(previous_end, start)).otherwise(F.lit(0).cast("bigint"))


def days_beyond(start: Column, end: Column, previous_end: Column) -> Column:
    """Days of the fill that the previous fill has not covered already."""
    fresh = F.greatest(F.lit(0).cast("bigint"), days_between(end, previous_end))
    return F.when(start <= previous_end, fresh).otherwise(days_between(end, start) + 1)
