"""Shared pieces of the corpus operators: staging of intermediate tables and size-checked broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where spark.checkpoint.dir is unset on a local master, as in tests.
DEFAULT_SHARED_DIR = "/tmp/checkpoints"

#: A key with more rows than this, and than a ten-thousandth of all rows, is joined by broadcast.
HOT_ROWS, HOT_SHARE = 2_000, 10_000

#: Bytes of an Arrow batch, see small_batches.
BATCH_BYTES = 8 << 20

#: White space of the word contracts, as a regular expression class.
WHITE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; on a cluster it has to name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = DEFAULT_SHARED_DIR
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches to and from Python tasks hold 8 MB at most; a smaller limit of the session stays.

    Executors keep several such batches per core outside the heap, in the JVM and in Python.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back.

    The table outlives executors, cuts the lineage and is computed once however
    often the result is read.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more; what was made from them has to be staged itself."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(docs: DataFrame) -> DataFrame:
    """docs and _row: its file (a hash of the path) and place there, the same whenever the row is read.

    What is not a plain scan of Parquet files is staged first.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = stage(docs, "numbered")
    return docs.withColumn("_row", F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")))


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Hint a broadcast only if a count proves that df (staged, narrow) has few rows."""
    return F.broadcast(df) if df.count() <= max_rows else df


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, n: str = "n", how: str = "inner") -> DataFrame:
    """rows joined (how: inner or left) with keyed, which has one row for each key and in n how many of rows have it.

    Keys with more than their share of rows are joined by broadcast, so no task gathers the
    rows of one: there are at most HOT_SHARE such keys, since each has more than that part of
    all rows. keyed is read several times and should be staged.
    """
    total, most = keyed.agg(F.sum(n), F.max(n)).first()
    limit = max(HOT_ROWS, (total or 0) // HOT_SHARE)
    if not most or most <= limit:
        return rows.join(keyed, key, how)
    hot = F.broadcast(keyed.where(F.col(n) > limit))
    cold = rows.join(hot.select(key), key, "left_anti").join(keyed.where(F.col(n) <= limit), key, how)
    return cold.unionByName(rows.join(hot, key))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; ASCII texts take the faster way."""
    slow = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(slow)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value worked out once for a row, even where a lambda inside body repeats it."""
    return F.transform(F.array(value), body)[0]
