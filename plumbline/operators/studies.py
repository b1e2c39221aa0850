"""Before and after a change: firing deltas over a corpus of packages, rates and hygiene."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def before_after(roster: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Firings of every check on the roster in both states, zero where none."""

    def tally(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("check_id").agg(F.count(F.lit(1)).alias(name))

    out = roster.join(tally(before, "before"), "check_id", "left").join(tally(after, "after"), "check_id", "left").na.fill(0, ["before", "after"])
    return out.withColumn("delta", F.col("after") - F.col("before"))


def unknown_checks(roster: DataFrame, fired: DataFrame) -> DataFrame:
    """Firings of checks that are not on the roster."""
    return fired.join(roster, "check_id", "left_anti")


def universal(deltas: DataFrame, packages: int) -> DataFrame:
    """Checks that fire on every package in both states: they tell nothing."""
    return deltas.where((F.col("before") == packages) & (F.col("after") == packages))


def false_positive_rate(deltas: DataFrame, packages: int) -> DataFrame:
    """Firings over runs of the covering checks."""
    c = deltas.where("covers = 'full'").agg(F.count(F.lit(1)).alias("checks"), F.sum("before").alias("before"), F.sum("after").alias("after"))
    runs = F.col("checks") * packages
    return c.select("checks", runs.alias("runs"), "before", "after", F.try_divide(F.col("after").cast("double"), runs.cast("double")).alias("rate"))


def uneven_runs(audits: DataFrame) -> DataFrame:
    """Packages that saw another number of checks than most: the study is void with any."""
    runs = audits.groupBy("pkg_id").agg(F.countDistinct("check_id").alias("checks_run"))
    usual = runs.agg(F.mode("checks_run").alias("usual"))
    return runs.crossJoin(F.broadcast(usual)).where("checks_run <> usual")


def duplicate_files(files: DataFrame, least: int = 2) -> DataFrame:
    """Byte-identical texts: digest, copies, first path."""
    return files.groupBy(F.sha2("text", 256).alias("digest")).agg(F.count(F.lit(1)).alias("copies"), F.min("path").alias("first_path")).where(F.col("copies") >= least)
