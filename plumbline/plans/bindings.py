"""How the driver's tables stand for the engine's: documents are files, their source is the package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Registry:
    """Queries by name, with the SQL that gives the same rows."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def put(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files of packages."""
    path = F.concat(F.lit("docs/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".md"))
    return table(spark, sf_dir, "documents").select(F.col("source").alias("pkg_id"), path.alias("path"), "text", "lang", "doc_id")


PACKAGES_SQL = "SELECT source AS pkg_id, 'docs/' || lpad(doc_id::VARCHAR, 8, '0') || '.md' AS path, text, lang, doc_id FROM documents"


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as judgments: a type is a skill, six providers, the id is the place in the record."""
    provider = F.col("user_id") % 6
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("skill"), F.concat(F.lit("p"), provider).alias("provider"), F.col("event_id").alias("pos"),
        F.col("value").alias("total"), provider.cast("int").alias("roster_ix"),
    )


JUDGMENTS_SQL = "SELECT event_type AS skill, 'p' || user_id % 6 AS provider, event_id AS pos, value AS total, (user_id % 6)::INTEGER AS roster_ix FROM events"


def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as assertion outcomes: orders are slugs, return flags tell the arms."""
    li = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'")
    return li.select(
        F.col("l_orderkey").alias("slug"), F.when(F.col("l_returnflag") == "A", "with").otherwise("without").alias("arm"),
        F.col("l_linenumber").alias("idx"), (F.col("l_quantity") > 20).alias("passed"), (F.col("l_orderkey") % 3 + 1).alias("iteration"),
    )


ARMS_SQL = "SELECT l_orderkey AS slug, CASE WHEN l_returnflag = 'A' THEN 'with' ELSE 'without' END AS arm, l_linenumber AS idx, l_quantity > 20 AS passed, l_orderkey % 3 + 1 AS iteration FROM lineitem WHERE l_returnflag <> 'R'"


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as cases: low quality is expected to fire, a plain text rule predicts."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fired = F.regexp_count("text", F.lit("[#*$%&|!]")) * 50 > F.length("text")
    return labels.join(docs, "doc_id").select(
        "doc_id", F.col("source").alias("category"), F.col("lang").alias("check_id"), (F.col("quality") == 0).alias("expected"), fired.alias("predicted")
    )


CASES_SQL = "SELECT doc_id, source AS category, lang AS check_id, quality = 0 AS expected, len(regexp_extract_all(text, '[#*$%&|!]')) * 50 > length(text) AS predicted FROM labels JOIN documents USING (doc_id)"


def permission_rows() -> list[tuple]:
    """Declared permissions that between them meet every rule of write reach and tier: name, write, deny_write, shell, allow."""
    return [
        ("none", [], [], False, []),
        ("reads", [], ["SOUL.md"], False, ["api.example.com"]),
        ("named", ["SOUL.md"], [], False, []),
        ("dotted", ["./MEMORY.md"], [], False, []),
        ("denied", ["SOUL.md", "out/a.txt"], ["SOUL.md"], False, []),
        ("glob", ["*.md"], [], False, []),
        ("stem", ["SOUL.*"], [], True, []),
        ("deep", ["secrets/**"], ["~/**"], True, ["*"]),
        ("all", ["**"], ["./**"], False, []),
        ("shell", [], [], True, []),
        ("taken", ["out/a.txt"], ["./out/a.txt"], True, []),
        ("bare", ["out/a.txt"], ["a.txt"], False, []),
        ("nested", ["memory/SOUL.md"], ["docs/AGENTS.md"], False, []),
        ("agents", ["AGENTS.md"], [], True, ["a.example.com", "b.example.com"]),
    ]
