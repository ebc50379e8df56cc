"""Lookup joins are lazy, complete and split frequent keys at run time."""

import pytest
from pyspark.sql import functions as F

from rxcover.operators.lookup import attach_lookup


@pytest.fixture(scope="module")
def frames(spark):
    # a third of the rows has key 0
    facts = spark.range(90_000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000).alias("key"), F.repeat(F.lit("x"), 40)
    )
    lookup = spark.range(0, 400_000, 2).select(F.col("id").alias("key"), F.concat(F.lit("n"), "id").alias("name"))
    return facts, lookup


@pytest.fixture
def settings(spark):
    kept = {}

    def put(**values):
        for key, value in values.items():
            key = key.replace("_", ".")
            kept.setdefault(key, spark.conf.get(key))
            spark.conf.set(key, value)

    yield put
    for key, value in kept.items():
        spark.conf.set(key, value)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_rows(frames, how):
    facts, lookup = frames
    joined = attach_lookup(facts, lookup, "key", how)
    assert joined.count() == (90_000 if how == "left" else facts.filter("key % 2 = 0").count())
    assert joined.filter("name <> concat('n', key)").count() == 0
    assert joined.filter("name IS NULL").filter("key % 2 = 0").count() == 0


def test_a_frequent_key_is_split_by_its_size(frames, settings):
    facts, lookup = frames
    settings(
        spark_sql_autoBroadcastJoinThreshold="-1",
        spark_sql_adaptive_advisoryPartitionSizeInBytes="64k",
        spark_sql_adaptive_skewJoin_skewedPartitionThresholdInBytes="64k",
        spark_sql_adaptive_skewJoin_skewedPartitionFactor="1.5",
    )
    joined = attach_lookup(facts.repartition(8), lookup, "key")
    joined.collect()
    final = joined._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "skew=true" in final
