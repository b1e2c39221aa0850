"""Queries of the corpus operators, each over its whole table, with SQL twins where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import chat, decontaminate, langid, linededup, merkle, minhash, mixing, quality, sharding, simhash, spelling, suffixes, warc
from plumbline.llm.common import stage, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by language, whose shares are far from even, so that the target entropy binds."""
    return mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("source")))


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of 50 and more words that occur in several documents."""
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


def op3_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as text without the boilerplate lines of their hosts."""
    return linededup.drop_boilerplate(table(spark, sf_dir, "pages"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 8)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that occur in windows of benchmark items."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures and verdict of every document."""
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, read back from seekable bundles."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


#: The vocabulary by which windows are measured, one of the public tokenizers of the machine.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A conversation whose texts hold every mark of a chat template.
HOSTILE = "\\### Assistant: </turn> ok"


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and one hostile one, read back from formatted windows."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", HOSTILE), (-7, 1, "assistant", HOSTILE)], "conv_id long, turn long, role string, text string"))
    return chat.read_back(stage(chat.format_windows(rows, vocabulary=VOCABULARY), "windows"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with a similarity of 0.85 or more on 3-word shingles."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three folds of four."""
    docs = table(spark, sf_dir, "documents")
    learned = docs.where(docs.doc_id.isNotNull() & ~langid.is_held_out(docs.doc_id))
    model = langid.fit(learned.select(F.col("doc_id").alias("key"), "text", "lang"))
    return langid.identify(docs.select("doc_id", langid.is_held_out(docs.doc_id).alias("held_out"), "text"), model, "doc_id", "held_out")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 4-word SimHash fingerprints are within 4 bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, distance=4)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents by source, and which rows it finds tampered with."""
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.tampered())


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the commoner words that they are variants of."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_suffixes": op2_suffixes,
    "op3_linededup": op3_linededup,
    "op4_sharding": op4_sharding,
    "op10_langid": op10_langid,
    "op5_decontaminate": op5_decontaminate,
    "op6_quality": op6_quality,
    "op7_warc": op7_warc,
    "op8_chat": op8_chat,
    "op9_minhash": op9_minhash,
    "op11_simhash": op11_simhash,
    "op12_merkle": op12_merkle,
    "op13_spelling": op13_spelling,
}

ORACLES: dict[str, str] = {
    "op1_mixing": mixing.oracle_sql("lang"),
    "op3_linededup": linededup.ORACLE_SQL,
    "op6_quality": quality.ORACLE_SQL,
    "op7_warc": warc.ORACLE_SQL,
    "op12_merkle": merkle.ORACLE_SQL,
    "op13_spelling": spelling.ORACLE_SQL,
}
