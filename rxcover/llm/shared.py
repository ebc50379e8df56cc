"""Tables, the shared folder and broadcasts of checked size."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A broadcast of ids is at most this many rows (8 bytes each, about 16 MB); above, an ordinary join is used.
BROADCAST_IDS = 2_000_000


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, for those that cannot import it themselves."""
    context = spark.sparkContext
    if not getattr(context, "_rxcover_sent", False):
        root = Path(__file__).resolve().parents[2]
        archive = Path(tempfile.mkdtemp(prefix="rxcover-package-")) / "rxcover"
        context.addPyFile(shutil.make_archive(str(archive), "zip", root, "rxcover"))
        context._rxcover_sent = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; only a local session that has none gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="rxcover-checkpoint-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/rxcover-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write `df` once to the shared folder and read it from there.

    Cuts the lineage: what follows survives lost executors without running the
    input again, and is computed once however often it is used.
    """
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.option("compression", compression).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def keep_ids(df: DataFrame, ids: DataFrame, key: str, count: int, anti: bool = False) -> DataFrame:
    """Rows of `df` whose `key` is in `ids` (one column, `count` rows), or with `anti` the others."""
    how = "left_anti" if anti else "left_semi"
    return df.join(F.broadcast(ids) if count <= BROADCAST_IDS else ids, key, how)


def remainder(column: str, divisor: int):
    """crc32 of an id as text, modulo `divisor`: splits ids into training and held-out ones."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor
