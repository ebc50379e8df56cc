"""Column expressions that turn PDC values and gaps into classes."""

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from rxcover.schema import (
    ADHERENT,
    GAP_SEVERITIES,
    LOWEST_PDC_BIN,
    MINIMAL_GAP,
    MODERATE,
    MODERATE_BAND,
    NON_ADHERENT,
    PDC_BINS,
    PDC_THRESHOLD,
)


def exact(number: Decimal | float | str) -> Decimal:
    """A threshold as the decimal that was typed, so 0.80 - 0.1 is exactly 0.70."""
    return Decimal(str(number))


def pdc_ratio(covered: Column, duration: Column) -> Column:
    """Covered share of the treatment as decimal, half-up at 4 digits; 0 without duration."""
    share = F.round(covered.cast("decimal(18,4)") / duration.cast("decimal(18,4)"), 4)
    return F.when(duration > 0, share).otherwise(F.lit(Decimal("0.0000")))


def adherence_status(pdc: Column, threshold: Decimal | float | str = PDC_THRESHOLD) -> Column:
    bound = exact(threshold)
    return (
        F.when(pdc >= F.lit(bound), ADHERENT)
        .when(pdc >= F.lit(bound - MODERATE_BAND), MODERATE)
        .otherwise(NON_ADHERENT)
    )


def gap_severity(gap_days: Column) -> Column:
    label = F.when(F.lit(False), MINIMAL_GAP)
    for least_days, name in GAP_SEVERITIES:
        label = label.when(gap_days >= least_days, name)
    return label.otherwise(MINIMAL_GAP)


def pdc_units(pdc: Column) -> Column:
    """PDC in ten-thousandths: an exact integer to sum, rank and bin."""
    return F.round(pdc * 10000).cast("bigint")


def pdc_bin(units: Column) -> Column:
    """Bin closed on the left: exactly 0.8 falls into 80-89%."""
    label = F.when(F.lit(False), LOWEST_PDC_BIN)
    for name, lower in PDC_BINS:
        label = label.when(units >= int(lower * 10000), name)
    return label.otherwise(LOWEST_PDC_BIN)


def pdc_bins_right_closed(units: Column) -> dict[str, Column]:
    """Bin tests closed on the right: exactly 0.8 falls into 70-79%; 0 and above 1 into none."""
    upper = 10000
    tests = {}
    for name, lower in PDC_BINS:
        tests[name] = (units > int(lower * 10000)) & (units <= upper)
        upper = int(lower * 10000)
    tests[LOWEST_PDC_BIN] = (units > 0) & (units <= upper)
    return dict(reversed(tests.items()))
