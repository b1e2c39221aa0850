"""Sharding by jump consistent hashing (Lamping and Veach 2014), with gapless slots in each shard."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import stage


@F.pandas_udf(T.IntegerType())
def jump_hash(key: pd.Series, shards: pd.Series) -> pd.Series:
    """The shard, 0 to shards - 1, of each 64-bit key, without any table.

    The key drives a linear congruential generator whose draws say at which next number of
    shards the key would move; the last such number below shards is its shard. So with one
    more shard a key stays or goes to the new one.
    """
    state = key.to_numpy(dtype=np.int64).view(np.uint64).copy()
    n = shards.to_numpy(dtype=np.int64)
    shard = np.zeros(len(state), dtype=np.int64)
    nxt = np.zeros(len(state), dtype=np.int64)
    live = np.flatnonzero(nxt < n)
    while len(live):
        shard[live] = nxt[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = ((state[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        nxt[live] = ((shard[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        live = live[nxt[live] < n[live]]
    return pd.Series(shard.astype(np.int32))


def shard_of(key: Column, shards: int) -> Column:
    """jump_hash of a long column; a null key hashes as 0."""
    return jump_hash(F.coalesce(key.cast("long"), F.lit(0)).cast("long"), F.lit(shards).cast("long"))


def with_slots(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add slot: each row's place from 0, without gaps, among the rows of its shard in the given order.

    rows has a column shard. The rows are sorted by shard and order over all tasks (a row
    number breaks ties, so that a key with very many rows is spread over several tasks)
    and staged; a row's slot is then its place in its file plus what earlier files hold.
    Only counts by file and shard are added up, never rows.
    """
    names = rows.columns
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["shard", *order, "_row"]
    ranged = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = stage(ranged.drop("_row"), "slots").select(
        *names,
        F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long").alias("_part"),
        F.regexp_extract("_metadata.file_name", r"-c(\d+)\.[^-]*$", 1).cast("long").alias("_piece"),  # a task's files, where their rows are limited
        F.col("_metadata.row_index").alias("_at"),
    )
    held = placed.groupBy("_part", "_piece", "shard").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first")).collect()  # a row for each file and shard that meet
    before: dict[int, int] = {}
    offsets = []
    for x in sorted(held, key=lambda x: (x["shard"], x["_part"], x["_piece"])):
        offsets.append((x["_part"], x["_piece"], x["shard"], before.get(x["shard"], 0) - x["_first"]))
        before[x["shard"]] = before.get(x["shard"], 0) + x["n"]
    known = spark.createDataFrame(offsets, "_part long, _piece long, shard int, _shift long")
    return placed.join(F.broadcast(known), ["_part", "_piece", "shard"]).select(*names, (F.col("_at") + F.col("_shift")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Deal documents into shards by jump consistent hashing of doc_id (law 'key').

    docs needs doc_id (long) and text; other columns are ignored, whatever their names.
    Returns one row per row of docs: doc_id, size (UTF-8 bytes of text, none for null,
    plus 1), text_crc32 (of the UTF-8 bytes; null for null), law, shard, slot (from 0 in
    each shard in the order of doc_id, null first, without gaps; repeated ids in an order
    of their own) and grown_shard (the shard with one more). A null doc_id is the key 0.
    An empty table gives an empty one.
    """
    key, text = F.col("doc_id").cast("long"), F.col("text")
    rows = docs.select(
        key.alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, shards).alias("shard"),
        shard_of(key, shards + 1).alias("grown_shard"),
    )
    return with_slots(rows, ["doc_id"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
