"""Evaluation runs as a tree of files: iteration-N / slug / arm[-k] / files, read into typed rows with their gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# --- fixed values: how runs are laid out, and what of their outputs is text ---
ARMS = ["with_skill", "without_skill"]
RUN = r"(?:^|/)iteration-(\d+)/([^/]+)/(with_skill|without_skill)(?:[-_](\d+))?/(.+)$"
RECORDS = ["grading.json", "timing.json", "run.json"]
CONTROL = "-control-"
PARTS = 1024
# --- end of fixed values ---


def read_tree(spark: SparkSession, workspace: str) -> DataFrame:
    """All files of runs below a workspace: iteration, slug, arm, repeat (1 where none is named), file, n_bytes, content.

    Folders that are no run are left out. Content is read only where it is used.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(workspace)
    return of_paths(files.select("path", F.col("length").alias("n_bytes"), "content"))


def of_paths(files: DataFrame) -> DataFrame:
    """The files of runs among files(path, n_bytes, content)."""
    found = F.regexp_extract("path", RUN, 0)
    rows = files.where(F.col("path").rlike(RUN)).select(F.split(F.ltrim(found, F.lit("/")), "/", 4).alias("p"), "n_bytes", "content")
    part = lambda i: F.get("p", F.lit(i))
    arm = F.when(part(2).startswith(ARMS[0]), ARMS[0]).otherwise(ARMS[1])
    turn = F.substr(part(2), F.length(arm) + 2)
    return rows.select(
        F.substr(part(0), F.lit(len("iteration-") + 1)).cast("int").alias("iteration"), part(1).alias("slug"), arm.alias("arm"), F.when(turn == "", 1).otherwise(F.try_to_number(turn, F.lit("999999999")).cast("int")).alias("repeat"),
        part(3).alias("file"), "n_bytes", "content",
    )


def _at(record: str, path: str, kind: str) -> Column:
    return F.try_variant_get(record, path, kind)


def _model(role: str, *records: str) -> Column:
    """The model of a role, in the first record that names it, in either spelling."""
    spelled = [F.nullif(F.trim(_at(r, p, "string")), F.lit("")) for r in records for p in (f"$.models.{role}", f"$.{role}_model")]
    return F.coalesce(*spelled)


def runs(tree: DataFrame) -> DataFrame:
    """One row for each run of the tree, graded or not.

    iteration, slug, arm, repeat, outputs (files below outputs/), graded, pass_rate, seconds,
    tokens, agent, grader, problem. What is absent is null, never zero. problem tells of a
    record that is not valid JSON, a run.json of another arm, and of an agent that graded
    itself.
    """
    key = ["iteration", "slug", "arm", "repeat"]  # texts are grouped by sorting, which is faster if what tells most runs apart comes first
    text = F.when(F.col("file").isin(RECORDS), F.col("content").cast("string"))
    held = {r.removesuffix(".json"): F.max(F.when(F.col("file") == r, text)).alias(r.removesuffix(".json")) for r in RECORDS}
    out = tree.groupBy(*reversed(key)).agg(*held.values(), F.count_if(F.col("file").startswith("outputs/")).alias("outputs"))
    broken = F.array_compact(F.array(*(F.when(F.col(r).isNotNull() & F.try_parse_json(r).isNull(), F.lit(f"{r}.json")) for r in held)))
    out = out.select(*key, "outputs", broken.alias("broken"), *(F.try_parse_json(r).alias(r) for r in held))
    agent, grader = _model("agent", "run", "grading", "timing"), _model("grader", "grading", "timing")
    said = _at("run", "$.configuration", "string")
    problem = (
        F.when(F.size("broken") > 0, F.concat(F.lit("not valid JSON: "), F.array_join("broken", ", ")))
        .when(said != F.col("arm"), F.concat(F.lit("run.json says "), said))
        .when(agent == grader, F.concat(agent, F.lit(" graded itself")))
    )
    return out.select(
        *key, "outputs", F.col("grading").isNotNull().alias("graded"), _at("grading", "$.summary.pass_rate", "double").alias("pass_rate"),
        (_at("timing", "$.duration_ms", "double") / 1000).alias("seconds"), _at("timing", "$.total_tokens", "double").alias("tokens"), agent.alias("agent"), grader.alias("grader"), problem.alias("problem"),
    )


def assertions(tree: DataFrame) -> DataFrame:
    """A row for each graded assertion: iteration, slug, arm, repeat, idx, text, passed, evidence, mechanism."""
    graded = tree.where("file = 'grading.json'").select("iteration", "slug", "arm", "repeat", F.try_parse_json(F.col("content").cast("string")).alias("g"))
    rows = F.coalesce(F.try_variant_get("g", "$.assertion_results", "array<variant>"), F.array().cast("array<variant>"))
    out = graded.select("iteration", "slug", "arm", "repeat", F.posexplode(rows).alias("idx", "a"))
    field = lambda name, kind: F.try_variant_get("a", f"$.{name}", kind).alias(name)
    return out.select("iteration", "slug", "arm", "repeat", "idx", field("text", "string"), field("passed", "boolean"), field("evidence", "string"), field("mechanism", "string"))


def latest(rows: DataFrame) -> DataFrame:
    """The rows of the highest iteration there is."""
    top = rows.agg(F.max("iteration").alias("iteration"))
    return rows.join(F.broadcast(top), "iteration", "left_semi")  # of one row


def pairs(found: DataFrame) -> DataFrame:
    """Both arms of each slug of an iteration: with_rate, without_rate (means over graded runs), missing (arms without one), delta.

    Slugs of which no run is graded in either arm are there too.
    """
    rate = lambda arm: F.avg(F.when((F.col("arm") == arm) & F.col("graded"), F.col("pass_rate")))
    seen = lambda arm: F.coalesce(F.bool_or(F.when(F.col("arm") == arm, F.col("graded"))), F.lit(False))
    out = found.groupBy("iteration", "slug").agg(rate(ARMS[0]).alias("with_rate"), rate(ARMS[1]).alias("without_rate"), seen(ARMS[0]).alias("w"), seen(ARMS[1]).alias("o"))
    missing = F.array_compact(F.array(F.when(~F.col("w"), ARMS[0]), F.when(~F.col("o"), ARMS[1])))
    return out.select("iteration", "slug", "with_rate", "without_rate", missing.alias("missing"), (F.col("with_rate") - F.col("without_rate")).alias("delta"))


def _pooled(parts: Column) -> Column:
    """n, mean and m2 (squares about the mean, summed) of an array of such, which are added in order of size, so always alike."""

    def add(a: Column, b: Column) -> Column:
        n, gap = a["n"] + b["n"], b["mean"] - a["mean"]
        both = F.struct(n.alias("n"), (a["mean"] + gap * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + gap * gap * a["n"] * b["n"] / n).alias("m2"))
        return F.when(a["n"] == 0, b).otherwise(both)

    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    return F.aggregate(F.array_sort(F.filter(parts, lambda p: p["n"] > 0)), none, add)


def summary(found: DataFrame, control: bool = False) -> DataFrame:
    """One row for each iteration and arm: runs, means and sample deviations of pass_rate, seconds and tokens, and how many runs have each.

    Only slugs that are graded in both arms count; excluded says how many others there are.
    With control, only slugs of blind controls count. A deviation of one run is null.

    Runs are read once and summed by slug and arm. The sums are pooled by parts of the slugs,
    then by arm, so no task meets all slugs of an iteration.
    """
    names = ["pass_rate", "seconds", "tokens"]
    rows = found.where(F.col("slug").contains(CONTROL)) if control else found
    figure = {c: F.when(F.col("graded"), F.col(c)) for c in names}
    moments = [F.struct(F.count(v).alias("n"), F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(v) * F.count(v), F.lit(0.0)).alias("m2")).alias(c) for c, v in figure.items()]
    by_slug = rows.groupBy("iteration", "slug", "arm").agg(F.count_if("graded").alias("runs"), *moments)
    slug = W.partitionBy("iteration", "slug")
    seen = lambda arm: F.coalesce(F.max((F.col("arm") == arm) & (F.col("runs") > 0)).over(slug), F.lit(False))
    told = by_slug.withColumns({"both": seen(ARMS[0]) & seen(ARMS[1]), "first": F.row_number().over(slug.orderBy("arm")) == 1, "part": F.pmod(F.hash("slug"), F.lit(PARTS))})
    counts = [F.count_if(F.col("first") & F.col("both")).alias("paired"), F.count_if(F.col("first") & ~F.col("both")).alias("excluded")]
    parts = told.groupBy("iteration", "arm", "part").agg(F.sum(F.when(F.col("both"), F.col("runs")).otherwise(0)).alias("runs"), *counts, *(F.collect_list(F.when(F.col("both"), F.col(c))).alias(c) for c in names))
    parts = parts.select("iteration", "arm", "runs", "paired", "excluded", *(_pooled(F.col(c)).alias(c) for c in names))
    arms = parts.groupBy("iteration", "arm").agg(*(F.sum(c).alias(c) for c in ("runs", "paired", "excluded")), *(F.collect_list(c).alias(c) for c in names))
    whole = W.partitionBy("iteration")
    arms = arms.select("iteration", "arm", "runs", *(_pooled(F.col(c)).alias(c) for c in names), *(F.sum(c).over(whole).alias(c) for c in ("paired", "excluded"))).where(F.col("runs") > 0)
    given = lambda c: [F.when(F.col(c)["n"] > 0, F.col(c)["mean"]).alias(f"{c}_mean"), F.when(F.col(c)["n"] > 1, F.sqrt(F.col(c)["m2"] / (F.col(c)["n"] - 1))).alias(f"{c}_sd"), F.col(c)["n"].alias(f"{c}_n")]
    return arms.select("iteration", "arm", "runs", *(x for c in names for x in given(c)), "paired", "excluded")


def deltas(summed: DataFrame) -> DataFrame:
    """with_skill less without_skill of each mean of a summary, by iteration."""
    mean = lambda c, arm: F.max(F.when(F.col("arm") == arm, F.col(f"{c}_mean")))
    return summed.groupBy("iteration").agg(*((mean(c, ARMS[0]) - mean(c, ARMS[1])).alias(f"delta_{c}") for c in ("pass_rate", "seconds", "tokens")))


def grading_order(found: DataFrame, seed: str = "order") -> DataFrame:
    """runs in an order that does not alternate arms and is the same at every call: place, from 0 in each iteration."""
    turn = F.sha2(F.concat_ws("|", F.lit(seed), "iteration", "slug", "arm", "repeat"), 256)
    return found.withColumn("place", F.row_number().over(W.partitionBy("iteration").orderBy(turn)) - 1)
