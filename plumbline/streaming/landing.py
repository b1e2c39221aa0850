"""Audit of files as they land: the text checks without state, and counts in windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from plumbline.operators.checks import file_hits

#: Files of the landing zone; landed_at is their event time.
SCHEMA = "pkg_id string, path string, text string, landed_at timestamp"


def read_landing(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the Parquet files that are put into a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def hits(files: DataFrame) -> DataFrame:
    """Hits of the text checks with the time of their file: a projection, so no state is held.

    Rows with hosts still have to be held against the package's allowlist (checks.undeclared).
    """
    keyed = files.select("pkg_id", "path", "text", "landed_at")
    found = file_hits(keyed.select(F.struct("pkg_id", "landed_at").alias("pkg_id"), "path", "text"))
    return found.select("pkg_id.pkg_id", "pkg_id.landed_at", "check_id", "path", "detail", "hosts")


def counts(found: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Hits by check in windows of event time; files later than the watermark are left out of windows already closed."""
    out = found.withWatermark("landed_at", late).groupBy(F.window("landed_at", width), "check_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("begins"), "check_id", "n")


def sink(found: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """Append to a Parquet folder, exactly once; the checkpoint folder has to be shared by driver and executors."""
    return found.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint)
