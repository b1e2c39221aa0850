"""A corpus in five stages: language, near duplicates, benchmark leaks, source mix, shards.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept. All but
the last return the columns of documents; each result is written as Parquet in the shared
folder and read again by the next, so a lost executor never costs more than its stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, langid, minhash, mixing, sharding
from plumbline.llm.common import broadcast_if_small, numbered, stage, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHARDS = 8


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs, numbered, without the rows whose _row is in gone."""
    return docs.join(broadcast_if_small(stage(gone.select("_row"), "gone")), "_row", "left_anti").select(COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in some language; null texts and texts without a letter go, and nothing else if no label can be learned from."""
    docs = docs.select(COLUMNS)
    model = langid.fit(docs.select(F.col("doc_id").alias("key"), "text", "lang"))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return langid.identify(docs, model, *COLUMNS).where("lang_pred <> 'und'").select(COLUMNS)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates (5-word shingles, 0.8): the one with the least doc_id.

    Rows are told apart by their places, so null and repeated ids are no copies by themselves;
    a null id comes last in its group. Texts without a word stay.
    """
    docs = numbered(docs)
    return _without(docs, minhash.near_duplicates(docs, row="_row").where("NOT chosen"))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that share no window with a benchmark item, whatever their ids."""
    docs = numbered(docs)
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), "_row")
    return _without(docs, found.where("contaminated"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and thin documents by source to the target weights."""
    return mixing.mixed(docs, mixing.plan(docs), *COLUMNS).select(COLUMNS)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deal documents into shards, with their places there."""
    rows = docs.select(*COLUMNS, sharding.shard_of(F.col("doc_id"), SHARDS).alias("shard"))
    return sharding.with_slots(rows, ["doc_id"])


STAGES = [("language", language), ("near_duplicates", dedup), ("leaks", leaks), ("mix", mix), ("shards", shards)]

#: SQL can express neither the language model nor the frozen sample; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
