"""Recorded responses of judges: what binds as a judgment, what does not and why, and the log of what was lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as t
from plumbline.operators.panel import MAXIMA

# --- fixed values: what a loss can be recorded as ---
FAILED, MALFORMED, UNAVAILABLE = "failed", "malformed", "unavailable"
# --- end of fixed values ---

LOG = "timestamp timestamp, provider string, status string, reason string, skill string, round int, response_excerpt string, response_chars int"


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit(""))


def _at(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def parse(responses: DataFrame, maxima: dict[str, int] | None = None) -> DataFrame:
    """responses(raw and more) with scores and whys (maps by dimension) and problem: its widest {...} as JSON, with a score and a reason for each dimension.

    problem is the first of: no JSON object, not valid JSON, no object of dimensions, missing
    dimensions, bare scores without a reason, an entry without score or why, an empty why, a
    score that is no whole number within its dimension's range, and one reason given for two
    dimensions (but for case and blanks). scores and whys are null then. A null raw is empty.
    """
    maxima = maxima or MAXIMA
    c = F.col
    block = F.regexp_extract(F.coalesce("raw", F.lit("")), r"(?s)\{.*\}", 0)
    out = responses.withColumn("_block", block).withColumn("_whole", F.try_parse_json("_block"))
    out = out.withColumn("_body", F.coalesce(_at(c("_whole"), "$.scores"), c("_whole")))
    # one struct for each dimension, worked out once: what kind of entry there is, and its score and why
    of_entry = lambda e: F.struct(
        _kind(e).alias("kind"), _kind(_at(e, "$.score")).alias("score_kind"), _kind(_at(e, "$.why")).alias("why_kind"), _at(e, "$.score", "double").alias("score"),
        F.when(_kind(_at(e, "$.why")) == "STRING", F.trim(_at(e, "$.why", "string"))).alias("why"),
    )
    names, tops = F.array(*map(F.lit, maxima)), F.array(*(F.lit(float(m)) for m in maxima.values()))
    out = out.withColumn("_dims", F.transform(F.array(*(_at(c("_body"), f"$.{d}") for d in maxima)), of_entry))

    def wrong(x: Column, i: Column) -> Column:
        name, top = F.get(names, i), F.get(tops, i)
        why = (
            F.when(x["score_kind"] == "", "no score").when(x["why_kind"] == "", "no why").when(F.coalesce(x["why"], F.lit("")) == "", "an empty why")
            .when(~x["score_kind"].rlike("^(?:BIGINT|DOUBLE|FLOAT|DECIMAL)"), "a score that is no number").when(x["score"] != F.floor(x["score"]), "a score that is no whole number")
            .when((x["score"] < 0) | (x["score"] > top), F.concat(F.lit("a score outside 0 to "), top.cast("int").cast("string")))
        )
        return F.concat(name, F.lit(": "), why)

    named = lambda f: F.array_compact(F.transform("_dims", lambda x, i: F.when(f(x), F.get(names, i))))
    listed = lambda label, found: F.when(F.size(found) > 0, F.concat(F.lit(f"{label}: "), F.array_join(found, ", ")))
    out = out.withColumn("_folded", F.transform("_dims", lambda x: t.fold(x["why"])))
    twin = F.get(F.array_compact(F.transform("_folded", lambda f, i: F.when(F.array_position("_folded", f) < i + 1, i))), F.lit(0))
    out = out.withColumn("_twin", twin)
    first = F.array_position("_folded", F.get("_folded", c("_twin"))).cast("int") - 1
    problem = F.coalesce(
        F.when(c("_block") == "", "no JSON object"), F.when(c("_whole").isNull(), "not valid JSON"), F.when(~_kind(c("_body")).startswith("OBJECT"), "no object of dimensions"),
        listed("missing", named(lambda x: x["kind"] == "")), listed("bare scores", named(lambda x: ~x["kind"].startswith("OBJECT"))), F.get(F.array_compact(F.transform("_dims", wrong)), F.lit(0)),
        F.when(c("_twin").isNotNull(), F.concat(F.get(names, first), F.lit(" and "), F.get(names, c("_twin")), F.lit(": the same why"))),
    )
    out = out.withColumn("problem", problem)
    held = lambda field: F.when(c("problem").isNull(), F.map_from_arrays(names, F.transform("_dims", lambda x: x[field])))
    return out.select(*responses.columns, held("score").alias("scores"), held("why").alias("whys"), "problem")


def outcomes(responses: DataFrame, maxima: dict[str, int] | None = None) -> DataFrame:
    """responses(skill, provider, round, raw, error) with scores, whys, total, status and reason.

    A response with an error failed; one that does not parse is malformed; status is null where
    it binds. A null raw without an error is malformed too.
    """
    out = parse(responses, maxima)
    failed = F.trim(F.coalesce("error", F.lit(""))) != ""
    status = F.when(failed, FAILED).when(F.col("problem").isNotNull(), MALFORMED)
    bound = status.isNull()
    total = F.aggregate(F.map_values("scores"), F.lit(0.0), lambda a, x: a + x)
    return out.select(
        *responses.columns, F.when(bound, F.col("scores")).alias("scores"), F.when(bound, F.col("whys")).alias("whys"), F.when(bound, total).alias("total"), status.alias("status"),
        F.when(failed, F.col("error")).otherwise(F.col("problem")).alias("reason"),
    )


def run_status(judged: DataFrame, *by: str) -> DataFrame:
    """failed (nothing binds), partial (something was lost) or complete, and how many of each, of outcomes."""
    out = judged.groupBy(*by).agg(F.count_if(F.col("status").isNull()).alias("pooled"), F.count("status").alias("refused"))
    state = F.when(F.col("pooled") == 0, "failed").when(F.col("refused") > 0, "partial").otherwise("complete")
    return out.withColumn("state", state)


def pool(judged: DataFrame, *by: str) -> DataFrame:
    """Mean of each dimension over the outcomes that bind, their sum, and how many there are."""
    means = judged.where("status IS NULL").select(*by, F.explode("scores").alias("dim", "score")).groupBy(*by, "dim").agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n"))
    one = F.map_from_entries(F.array_sort(F.collect_list(F.struct("dim", "mean"))))  # a row for each dimension
    return means.groupBy(*by).agg(one.alias("scores"), F.sum("mean").alias("total"), F.max("n").alias("providers"))


def losses(judged: DataFrame, at: Column | None = None) -> DataFrame:
    """The log rows (LOG) of outcomes that do not bind: redacted, clipped excerpts, with the length of what was said."""
    said = t.excerpt(F.col("raw"))
    has = F.coalesce(F.col("raw"), F.lit("")) != ""
    return judged.where("status IS NOT NULL").select(
        (F.current_timestamp() if at is None else at).alias("timestamp"), "provider", "status", "reason", "skill", F.col("round").cast("int").alias("round"),
        F.when(has, said["excerpt"]).alias("response_excerpt"), F.when(has, said["chars"]).alias("response_chars"),
    )


def append_log(rows: DataFrame, path: str) -> None:
    """Append rows of LOG to the log below path (JSON lines); rows without a reason or with another status end the write.

    Files are only added, so earlier entries stay as they are whoever writes at the same time.
    """
    wrong = (F.trim(F.coalesce("reason", F.lit(""))) == "") | ~F.coalesce(F.col("status").isin(FAILED, MALFORMED, UNAVAILABLE), F.lit(False))
    checked = rows.withColumn("status", F.when(wrong, F.raise_error(F.concat(F.lit("cannot be recorded: "), F.coalesce("provider", F.lit("?"))))).otherwise(F.col("status")))
    checked.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).json(path)


def roster(declared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Providers of declared(provider, available, reason) that can be asked, and the log rows of those that cannot."""
    gone = declared.where("NOT available").select(
        F.current_timestamp().alias("timestamp"), "provider", F.lit(UNAVAILABLE).alias("status"), "reason", *(F.lit(None).cast(k).alias(n) for n, k in (("skill", "string"), ("round", "int"), ("response_excerpt", "string"), ("response_chars", "int")))
    )
    return declared.where("available").select("provider"), gone
