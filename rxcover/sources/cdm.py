"""The four input tables, from a catalog schema or from Parquet folders."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from rxcover import schema

SCHEMAS = {
    "drug_exposure": schema.DRUG_EXPOSURE,
    "concept": schema.CONCEPT,
    "person": schema.PERSON,
    "condition_occurrence": schema.CONDITION_OCCURRENCE,
}


def conform(df: DataFrame, target) -> DataFrame:
    """The table's known columns in lower case with their declared types."""
    return df.selectExpr(*[f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in target.fields])


class CdmTables:
    """Input tables, each looked up when it is first used."""

    def __init__(self, readers: Mapping[str, Callable[[], DataFrame]]):
        self._readers = readers

    @cached_property
    def drug_exposure(self) -> DataFrame:
        return self._readers["drug_exposure"]()

    @cached_property
    def concept(self) -> DataFrame:
        return self._readers["concept"]()

    @cached_property
    def person(self) -> DataFrame:
        return self._readers["person"]()

    @cached_property
    def condition_occurrence(self) -> DataFrame:
        return self._readers["condition_occurrence"]()

    @classmethod
    def of(cls, **frames: DataFrame) -> CdmTables:
        """From frames named like the tables."""
        return cls({name: (lambda df=df, name=name: conform(df, SCHEMAS[name])) for name, df in frames.items()})

    @classmethod
    def from_catalog(cls, spark: SparkSession, schema_name: str) -> CdmTables:
        return cls._located(lambda table: spark.table(f"{schema_name}.{table}"))

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str) -> CdmTables:
        return cls._located(lambda table: spark.read.parquet(f"{folder}/{table}"))

    @classmethod
    def _located(cls, read: Callable[[str], DataFrame]) -> CdmTables:
        return cls({name: (lambda name=name: conform(read(name), SCHEMAS[name])) for name in SCHEMAS})
