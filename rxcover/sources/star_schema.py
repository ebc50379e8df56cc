"""CDM tables derived from an order/line-item star schema.

Every row of the source tables is used. Remainders only decide which rule a row
follows, so that missing values, unknown drugs, unlinked persons and reversed
dates all occur. Ids follow the order and line number, so they repeat where those
do; operators that order by id go on to the other columns.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxcover import schema
from rxcover.sources.cdm import CdmTables, conform

WINDOW = ("2020-01-01", "2021-12-20")
AS_OF = "2021-12-20"
DAYS_IN_WINDOW = 720

# Declared, so that reading a table starts no job to find its columns.
SOURCES = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "customer": "c_custkey bigint",
    "part": "p_partkey bigint, p_name string, p_type string",
    "nation": "n_nationkey int, n_name string",
}


def _fold(day: str) -> str:
    """Any date moved into the window, keeping its order within each 720 days."""
    return f"date_add(DATE '{WINDOW[0]}', pmod(datediff({day}, DATE '1995-01-01'), {DAYS_IN_WINDOW}))"


def _drug_exposure(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    fills = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
        "l_orderkey * 8 + l_linenumber AS drug_exposure_id",
        "o_custkey AS person_id",
        "CASE WHEN l_orderkey < 5 THEN 8 WHEN l_orderkey < 35 THEN 9 ELSE l_partkey % 8 END AS drug_concept_id",
        f"CASE WHEN l_linenumber <> 7 OR l_suppkey % 9 <> 8 THEN {_fold('l_shipdate')} END "
        "AS drug_exposure_start_date",
        "CASE WHEN l_linenumber = 1 AND (l_partkey % 16 = 3 OR o_custkey % 10 = 4) "
        f"THEN date_sub({_fold('l_shipdate')}, CAST(2 + l_partkey % 3 AS INT)) "
        f"WHEN l_linenumber = 1 THEN date_add({_fold('l_shipdate')}, CAST(l_quantity * 4 - 1 AS INT)) END "
        "AS drug_exposure_end_date",
        "CASE WHEN l_partkey % 8 = 5 THEN NULL WHEN l_linenumber IN (2, 3) THEN 30 * (1 + l_suppkey % 4) "
        "WHEN l_linenumber = 4 THEN 0 END AS days_supply",
        "CASE WHEN l_linenumber IN (4, 5) THEN l_suppkey % 5 END AS refills",
        "l_quantity AS quantity",
        "CASE WHEN l_returnflag = 'A' THEN 38000175 WHEN l_returnflag = 'N' THEN 38000176 "
        "WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 581373 ELSE 38000180 END AS drug_type_concept_id",
    )
    return conform(fills, schema.DRUG_EXPOSURE)


def _concept(part: DataFrame, nation: DataFrame) -> DataFrame:
    """Ten drug concepts, each from a tenth of the parts, and one concept per nation.

    Drug 7 and condition 1006 have no concept; drug 6 and condition 1005 are in
    another domain; drug 4 and condition 1002 have no name.
    """
    drugs = (
        part.groupBy((F.col("p_partkey") % 10).alias("tenth"))
        .agg(F.min_by("p_name", "p_partkey").alias("name"), F.min_by("p_type", "p_partkey").alias("class"))
        .selectExpr(
            "CASE WHEN tenth = 7 THEN 70 ELSE tenth END AS concept_id",
            "CASE WHEN tenth <> 4 THEN name END AS concept_name",
            "class AS concept_class_id",
            "CASE WHEN tenth = 6 THEN 'Device' ELSE 'Drug' END AS domain_id",
        )
    )
    conditions = nation.selectExpr(
        "CASE WHEN n_nationkey < 6 THEN 1000L ELSE 2000L END + n_nationkey AS concept_id",
        "CASE WHEN n_nationkey <> 2 THEN n_name END AS concept_name",
        "'Clinical Finding' AS concept_class_id",
        "CASE WHEN n_nationkey = 5 THEN 'Observation' ELSE 'Condition' END AS domain_id",
    )
    return conform(drugs.unionByName(conditions), schema.CONCEPT)


def _person(customer: DataFrame) -> DataFrame:
    """All customers; one in forty has an id that no fill refers to."""
    persons = customer.selectExpr(
        "CASE WHEN c_custkey % 40 = 39 THEN -c_custkey ELSE c_custkey END AS person_id",
        "1930 + c_custkey % 70 AS year_of_birth",
    )
    return conform(persons, schema.PERSON)


def _condition_occurrence(orders: DataFrame) -> DataFrame:
    occurrences = orders.selectExpr(
        "o_custkey AS person_id",
        "1000 + o_orderkey % 7 AS condition_concept_id",
        f"{_fold('o_orderdate')} AS condition_start_date",
    )
    return conform(occurrences, schema.CONDITION_OCCURRENCE)


def cdm_from_star_schema(spark: SparkSession, folder: str) -> CdmTables:
    def read(name: str) -> DataFrame:
        return spark.read.schema(SOURCES[name]).parquet(f"{folder}/{name}.parquet")

    return CdmTables(
        {
            "drug_exposure": lambda: _drug_exposure(read("lineitem"), read("orders")),
            "concept": lambda: _concept(read("part"), read("nation")),
            "person": lambda: _person(read("customer")),
            "condition_occurrence": lambda: _condition_occurrence(read("orders")),
        }
    )
