"""Scorecards: JSON files of judged rounds, read strictly; what cannot be read is a row with its reason, never an empty card."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def parsed(texts: DataFrame) -> DataFrame:
    """file, card (VARIANT) and problem (null, or why there is no card) of texts(file, text)."""
    card = F.try_parse_json("text")
    problem = F.when(card.isNull(), "not valid JSON").when(~F.schema_of_variant(card).startswith("OBJECT"), "no JSON object")
    return texts.select("file", F.when(problem.isNull(), card).alias("card"), problem.alias("problem"))


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """The *.json files of a folder: file (its name), card, problem."""
    whole = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return parsed(whole.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text")))


def _of(path: str, kind: str = "variant") -> Column:
    return F.try_variant_get("card", path, kind)


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit(""))


def _number(value: Column) -> Column:
    """Is a value a number? (Of a boolean: no.)"""
    return _kind(value).rlike("^(?:BIGINT|DOUBLE|FLOAT|DECIMAL)")


def skill() -> Column:
    """What a card is about: its skill, or else its file's name."""
    return F.coalesce(F.nullif(_of("$.skill", "string"), F.lit("")), F.regexp_replace("file", r"\.json$", ""))


def judgments(cards: DataFrame) -> DataFrame:
    """A row for each judgment of cards: file, skill, provider, round_index, pos, total, scores, problem.

    round_index counts a provider's own rows of a card, in order. scores is a map, null where
    the judgment recorded none. A problem tells of a card or a row that cannot be read: an
    entry that is no object, a total or a score that is no number, scores that are no object;
    such a row has neither total nor scores.
    """
    rows = F.coalesce(_of("$.judgments", "array<variant>"), F.array().cast("array<variant>"))
    out = cards.select("file", F.when(F.col("card").isNotNull(), skill()).alias("skill"), "problem", F.posexplode_outer(rows).alias("pos", "row"))
    out = out.where(F.col("row").isNotNull() | F.col("problem").isNotNull() | F.col("pos").isNotNull())
    get = lambda path, kind="variant": F.try_variant_get("row", path, kind)
    provider = F.coalesce(F.nullif(get("$.provider", "string"), F.lit("")), F.lit("<unnamed>"))
    given = _kind(get("$.scores"))
    each = F.map_entries(F.coalesce(get("$.scores", "map<string, variant>"), F.create_map().cast("map<string, variant>")))
    odd = F.get(F.filter(each, lambda e: ~_number(e["value"])), F.lit(0))["key"]
    problem = F.coalesce(
        "problem",
        F.when(~_kind(F.col("row")).startswith("OBJECT"), "a judgment is no object"),
        F.when(~_number(get("$.total")), F.concat(F.lit("no numeric total from "), provider)),
        F.when(~given.isin("", "VOID") & ~given.startswith("OBJECT"), F.concat(F.lit("scores are no object from "), provider)),
        F.when(odd.isNotNull(), F.concat(provider, F.lit(" scored "), odd, F.lit(", which is no number"))),
    )
    in_turn = W.partitionBy("file", "provider").orderBy("pos")
    sound = F.col("problem").isNull()
    out = out.select("file", "skill", F.when(F.col("row").isNotNull(), provider).alias("provider"), "pos", problem.alias("problem"), get("$.total", "double").alias("total"), get("$.scores", "map<string, double>").alias("scores"))
    return out.select(
        "file", "skill", "provider", F.when(sound, F.row_number().over(in_turn) - 1).alias("round_index"), "pos",
        F.when(sound, F.col("total")).alias("total"), F.when(sound, F.col("scores")).alias("scores"), "problem",
    )


def strict(rows: DataFrame) -> DataFrame:
    """rows, which end the query with the reason if one of them has a problem."""
    told = F.concat("file", F.lit(": "), "problem")
    return rows.withColumn("file", F.when(F.col("problem").isNotNull(), F.raise_error(told)).otherwise(F.col("file"))).where("file IS NOT NULL").drop("problem")


def aggregates(cards: DataFrame) -> DataFrame:
    """What panel.ship_verdict reads of the cards that have an aggregate: file, skill, method, rubric_sha, totals, stored, dim_means, verdict."""
    held = cards.where(F.col("card").isNotNull() & _kind(_of("$.aggregate")).startswith("OBJECT"))
    agg = "$.aggregate"
    figures = F.map_filter(F.coalesce(_of(agg, "map<string, variant>"), F.create_map().cast("map<string, variant>")), lambda _, v: _number(v))
    return held.select(
        "file", skill().alias("skill"), _of(f"{agg}.method", "string").alias("method"), _of(f"{agg}.rubric_sha", "string").alias("rubric_sha"),
        F.coalesce(_of(f"{agg}.judgments", "array<double>"), F.array().cast("array<double>")).alias("totals"),
        F.transform_values(figures, lambda _, v: F.try_variant_get(v, "$", "double")).alias("stored"),
        _of(f"{agg}.dim_means", "map<string, double>").alias("dim_means"), _of("$.verdict", "string").alias("verdict"),
    )
