"""Exact means and shares, safe on empty input, and plain output types."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rounded_ratio(numerator: Column, denominator: Column, places: int) -> Column:
    """numerator / denominator of two integers, half-up, as double; NULL for x / 0."""
    share = numerator.cast("decimal(20,0)") / F.nullif(denominator, F.lit(0)).cast("decimal(20,0)")
    return F.round(share, places).cast("double")


def ratio(numerator: Column, denominator: Column) -> Column:
    return numerator.cast("double") / F.nullif(denominator, F.lit(0)).cast("double")


def percent(part: Column, whole: Column) -> Column:
    return ratio(part * 100, whole)


def plain_types(df: DataFrame) -> DataFrame:
    """Decimals as double and integers as bigint, decided by the schema."""
    kinds = {T.DecimalType: "double", T.IntegerType: "bigint"}
    return df.select(
        *[
            F.col(field.name).cast(kinds[type(field.dataType)]).alias(field.name)
            if type(field.dataType) in kinds
            else F.col(field.name)
            for field in df.schema.fields
        ]
    )
