"""Fills stored in sorted buckets of patient and drug, so that coverage and PDC need no shuffle."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rxcover import schema
from rxcover.sources.cdm import conform

ORDER = [*schema.PATIENT_DRUG, "drug_exposure_start_date", "drug_exposure_id"]


def store_fills(drug_exposure: DataFrame, table: str, buckets: int, files: int = 1) -> DataFrame:
    """Write the fills as a catalog table of `buckets` buckets and read it back.

    Rows are dealt by bucket before the write, so a bucket has `files` files and
    not one per task; more files than one spread a large bucket over as many
    writers. Rows are sorted within a file, so scans skip by patient and drug. A
    patient-drug lies in one bucket; measure with `bucket_rows` whether one holds
    too much, in which case plain files and the counted spans are the better way.
    """
    part = F.pmod(F.xxhash64("drug_exposure_id"), F.lit(files))
    bucket = F.pmod(F.hash(*schema.PATIENT_DRUG), F.lit(buckets))  # the hash that Spark's buckets use
    dealt = conform(drug_exposure, schema.DRUG_EXPOSURE).repartition(buckets * files, bucket, part)
    writer = dealt.write.mode("overwrite").bucketBy(buckets, *schema.PATIENT_DRUG).sortBy(*ORDER)
    writer.saveAsTable(table)
    return stored_fills(drug_exposure.sparkSession, table)


def stored_fills(spark: SparkSession, table: str) -> DataFrame:
    return conform(spark.table(table), schema.DRUG_EXPOSURE)


def bucket_rows(fills: DataFrame, buckets: int) -> DataFrame:
    """`bucket`, `rows`, and `times_mean`, how many times the mean of all buckets each one holds.

    Works on any fills, so a layout can be judged before it is written.
    """
    bucket = F.pmod(F.hash(*schema.PATIENT_DRUG), F.lit(buckets)).alias("bucket")
    counts = fills.groupBy(bucket).agg(F.count("*").alias("rows"))
    every = fills.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(counts, "bucket", "left").select("bucket", F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"))
    mean = F.avg("rows").over(Window.partitionBy())  # one row a bucket
    return filled.withColumn("times_mean", F.col("rows") / F.nullif(mean, F.lit(0.0)))
