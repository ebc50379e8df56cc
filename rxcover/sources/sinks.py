"""CSV export of results, with a manifest by which a reader knows that it is whole."""

import tempfile
import uuid
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# file name and row order of each result
EXPORTS = {
    "pdc": ("pdc_results", ["person_id", "drug_concept_id"]),
    "drug_summary": ("drug_summary", ["-unique_patients", "drug_name"]),
    "gaps": ("gap_details", ["person_id", "drug_concept_id", "fill_sequence"]),
}


def export_csv(folder: str, at: datetime | None = None, **results: DataFrame) -> dict[str, str]:
    """Write `pdc`, `drug_summary` and `gaps` to time-stamped CSV folders with a header.

    Rows are range-partitioned into the result's order (its keys are unique), so
    the part files follow one another and no task or the driver sees all rows.
    When all are written, a manifest follows with columns, rows and a checksum of
    the lines of each, read back from the files. The folder must be one that all
    executors share.
    """
    stamp = (at or datetime.now()).strftime("%Y%m%d_%H%M%S")
    written, entries = {}, []
    for name, df in results.items():
        file, order = EXPORTS[name]
        written[name] = f"{folder}/{file}_{stamp}.csv"
        keys = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]
        df.orderBy(*keys).write.option("header", True).csv(written[name])
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        entries.append((name, written[name].rpartition("/")[2], columns, *_contents(df.sparkSession, written[name], columns)))
    if entries:
        spark = next(iter(results.values())).sparkSession
        manifest = spark.createDataFrame(entries, MANIFEST).coalesce(1)  # a row per result
        manifest.write.json(f"{folder}/manifest_{stamp}.json")
    return written


MANIFEST = "name string, file string, columns string, rows long, lines long, checksum string"


def _contents(spark: SparkSession, path: str, columns: str) -> tuple[int, int, str]:
    """Rows, lines and a checksum of the lines that does not depend on their order."""
    lines = spark.read.text(path).agg(
        F.count("*").alias("lines"),
        F.coalesce(F.sum(F.xxhash64("value").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("checksum"),
    )
    found = lines.first()
    return _csv(spark, path, columns).count(), found["lines"], str(found["checksum"])


def _csv(spark: SparkSession, path: str, columns: str) -> DataFrame:
    return spark.read.schema(columns).option("header", True).csv(path)


class IncompleteExport(ValueError):
    """The export has no manifest, or its files are not those that the manifest names."""


def read_export(spark: SparkSession, folder: str, stamp: str = "*") -> dict[str, DataFrame]:
    """The results of the export of that time stamp (or of all in the folder), with their column types.

    Refuses an export without a manifest, which is written last, and one whose
    files have lost, gained or changed lines since.
    """
    try:
        entries = spark.read.schema(MANIFEST).json(f"{folder}/manifest_{stamp}.json").collect()
    except AnalysisException as missing:
        raise IncompleteExport(f"no manifest in {folder}") from missing
    results = {}
    for entry in entries:
        path = f"{folder}/{entry['file']}"
        try:
            found = _contents(spark, path, entry["columns"])
        except AnalysisException as missing:
            raise IncompleteExport(f"{path} is missing") from missing
        if found != (entry["rows"], entry["lines"], entry["checksum"]):
            raise IncompleteExport(f"{path} is not what was written")
        results[entry["name"]] = _csv(spark, path, entry["columns"])
    return results


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below `spark.checkpoint.dir`; only a local session without one gets a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        shared = tempfile.mkdtemp(prefix="rxcover-export-")
    return f"{shared.rstrip('/')}/rxcover-export-{uuid.uuid4().hex}"
