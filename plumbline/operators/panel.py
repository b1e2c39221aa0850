"""Judge panels: pooled statistics, bias, quality, sensitivity and missing attempts.

judgments has skill, provider, pos (place in the record) and total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

# --- fixed values ---
TARGET, K, LEAST = 108.0, 1.0, 4
FLOORS = {"D1": 17, "D2": 13, "D3": 13, "D4": 13, "D5": 13, "D6": 13, "D7": 8, "D8": 13}
MAXIMA = {"D1": 20, "D2": 15, "D3": 15, "D4": 15, "D5": 15, "D6": 15, "D7": 10, "D8": 15}
BANDS = [("A", 108.0), ("B", 96.0), ("C", 84.0), ("D", 72.0)]
#: The bar of the spread clause that no longer decides anything.
LOWER = 105.0
METHOD, RUBRIC = "multi-round-independent-pooled", "3027f20f3181758385a1bb8c022d4041dfb4de84"
#: Figures that every stored aggregate has; the two that came later are held to only where they are stored.
STORED, LATER = ["n", "mean", "median", "min", "max", "range", "stdev", "lower_bound"], ["sem", "ci_lower"]
INDEPENDENT = ["live-subagent-skill-judge", "live-independent-dual-judge-min", "live-independent-dual-judge-min-pinned-rubric"]
ITERATION = r"^iter-(\d+)-live$"
#: Signs of a judge that does not tell skills apart.
FEW_SKILLS, FEW_VALUES, LOW_SPREAD, ROUND_RATE, TOP_RATE = 2, 4, 1.0, 0.60, 0.50
# --- end of fixed values ---


def pooled(judgments: DataFrame, *by: str) -> DataFrame:
    """n, mean, median, min, max, range, sample deviation, standard error and both lower bounds, unrounded."""
    out = judgments.groupBy(*by).agg(
        F.count("total").alias("n"), F.avg("total").alias("mean"), F.median("total").alias("median"), F.min("total").alias("min"),
        F.max("total").alias("max"), F.stddev_samp("total").alias("stdev"),
    )
    sem = F.col("stdev") / F.sqrt("n")
    return out.withColumns(
        {
            "range": F.col("max") - F.col("min"),
            "lower_bound": F.col("mean") - F.col("stdev"),
            "sem": sem,
            "ci_lower": F.col("mean") - K * sem,
        }
    )


@F.pandas_udf(T.DoubleType())
def round_as_published(x, digits):
    """Round half to even on the exact binary value, as the published figures are."""
    import pandas as pd

    return pd.Series([None if v is None or v != v else round(float(v), int(d)) for v, d in zip(x, digits, strict=True)], dtype="float64")


def published(stats: DataFrame) -> DataFrame:
    """Figures rounded at the published places, each from its rounded predecessor; small panels only."""

    def r(c: Column, d: int) -> Column:
        return round_as_published(c.cast("double"), F.lit(d))

    out = stats.where(F.col("n") >= LEAST).select(
        *(c for c in stats.columns if c not in ("mean", "median", "stdev", "sem", "lower_bound", "ci_lower")),
        r(F.col("mean"), 1).alias("mean"), r(F.col("median"), 1).alias("median"), r(F.col("stdev"), 2).alias("stdev"),
    )
    out = out.withColumn("sem", r(F.col("stdev") / F.sqrt("n"), 2))
    return out.withColumns({"lower_bound": r(F.col("mean") - F.col("stdev"), 1), "ci_lower": r(F.col("mean") - K * F.col("sem"), 1)})


def dim_means(scores: DataFrame) -> DataFrame:
    """Mean of each dimension over complete breakdowns of judgments(skill, scores map)."""
    whole = scores.where(F.size("scores") == len(FLOORS))
    return whole.select("skill", F.explode("scores").alias("dim", "score")).groupBy("skill", "dim").agg(F.avg("score").alias("mean"))


def lowest_dimension(means: DataFrame, floors: DataFrame) -> DataFrame:
    """The dimension nearest to, or furthest below, its floor."""
    gap = means.join(F.broadcast(floors), "dim").withColumn("gap", F.col("mean") - F.col("floor"))
    return gap.groupBy("skill").agg(F.min(F.struct("gap", "dim")).alias("x")).select("skill", F.col("x.dim").alias("dim"), F.col("x.gap").alias("gap"))


def ship_gate(stats: DataFrame, target: float = TARGET, least: int = LEAST) -> DataFrame:
    """The first clause that blocks, or ships."""
    reason = (
        F.when(F.col("n") < least, "too-few-judgments")
        .when(F.col("mean").isNull() | F.col("ci_lower").isNull(), "missing-statistics")
        .when(F.col("mean") < target, "mean-below-target")
        .when(F.col("ci_lower") < target, "bound-below-target")
        .otherwise("ships")
    )
    return stats.withColumn("verdict_reason", reason).withColumn("ships", reason == "ships")


def _figures(totals: Column) -> dict[str, Column]:
    """The published figures of an array of totals, each rounded from its rounded predecessors; of many, not of few."""

    def r(c: Column, d: int) -> Column:
        return round_as_published(c.cast("double"), F.lit(d))

    n = F.size(totals)
    total = F.aggregate(totals, F.lit(0.0), lambda a, x: a + x)
    mean = F.try_divide(total, n)
    squares = F.aggregate(totals, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    ordered = F.array_sort(totals)
    middle = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
    raw = {"mean": mean, "median": middle, "stdev": F.sqrt(F.try_divide(squares, n - 1))}
    return {
        "n": n.cast("double"), "mean": r(raw["mean"], 1), "median": r(raw["median"], 1), "stdev": r(raw["stdev"], 2), "min": F.array_min(totals), "max": F.array_max(totals),
        "range": F.array_max(totals) - F.array_min(totals),
    }


def card_figures(cards: DataFrame) -> DataFrame:
    """cards(totals and more) with the published figures of their totals, in columns of their names."""
    out = cards.withColumns(_figures(F.col("totals")))
    out = out.withColumn("sem", round_as_published(F.try_divide(F.col("stdev"), F.sqrt("n")), F.lit(2)))
    return out.withColumns({"lower_bound": round_as_published(F.col("mean") - F.col("stdev"), F.lit(1)), "ci_lower": round_as_published(F.col("mean") - K * F.col("sem"), F.lit(1))})


def ship_verdict(cards: DataFrame, target: float = TARGET, least: int = LEAST) -> DataFrame:
    """The verdict on each of cards(method, rubric_sha, totals, stored, dim_means and more), worked out from its totals.

    Adds ships, clause (the first that blocks: method, rubric, rounds, missing-statistics,
    drift, floors, mean, bound; null where it ships), detail (the figures or dimensions that
    the clause names) and the figures recomputed from totals. A stored figure that differs
    from the recomputed one is drift, whichever it is; a dimension without a mean has 0.
    """
    out = card_figures(cards).withColumnsRenamed({k: f"_{k}" for k in (*STORED, *LATER)})
    stored = F.coalesce("stored", F.create_map().cast("map<string, double>"))
    among = lambda names, wrong: F.array_compact(F.array(*(F.when(wrong(k), F.lit(k)) for k in names)))
    missing = among(STORED, lambda k: ~F.map_contains_key(stored, F.lit(k)))
    drift = among([*STORED, *LATER], lambda k: F.map_contains_key(stored, F.lit(k)) & ~F.try_element_at(stored, F.lit(k)).eqNullSafe(F.col(f"_{k}")))
    dims = F.coalesce("dim_means", F.create_map().cast("map<string, double>"))
    low = among(FLOORS, lambda k: F.coalesce(F.try_element_at(dims, F.lit(k)), F.lit(0.0)) < FLOORS[k])
    joined = lambda names: F.array_join(names, ", ")
    clauses = [
        ("method", ~F.col("method").eqNullSafe(METHOD), F.coalesce("method", F.lit("none"))),
        ("rubric", ~F.col("rubric_sha").eqNullSafe(RUBRIC), F.coalesce("rubric_sha", F.lit("none"))),
        ("rounds", F.size("totals") < least, F.size("totals").cast("string")),
        ("missing-statistics", F.size(missing) > 0, joined(missing)),
        ("drift", F.size(drift) > 0, joined(drift)),
        ("floors", F.size(low) > 0, joined(low)),
        ("mean", F.col("_mean") < target, F.col("_mean").cast("string")),
        ("bound", F.col("_ci_lower") < target, F.col("_ci_lower").cast("string")),
    ]
    first = lambda what: F.coalesce(*(F.when(blocked, what(c, d)) for c, blocked, d in clauses))
    out = out.withColumns({"clause": first(lambda c, _: F.lit(c)), "detail": first(lambda _, d: d)})
    names = {k: F.col(f"_{k}").alias(k) for k in ("n", "mean", "stdev", "sem", "ci_lower")}
    return out.select(*cards.columns, F.col("clause").isNull().alias("ships"), "clause", "detail", *names.values())


def audit_cards(cards: DataFrame) -> DataFrame:
    """Cards whose stored verdict (SHIP or BLOCKED) is not the one that their totals give: file, skill, verdict, recomputed, clause."""
    said = ship_verdict(cards).withColumn("recomputed", F.when(F.col("ships"), "SHIP").otherwise("BLOCKED"))
    return said.where(F.col("verdict").isNotNull() & (F.col("verdict") != F.col("recomputed"))).select("file", "skill", "verdict", "recomputed", "clause")


def block_verdict(blocks: DataFrame, target: float = TARGET) -> DataFrame:
    """The verdict on single blocks(method, total, dims map and more): adds ships and clause (method, sum, floors, total)."""
    dims = F.coalesce("dims", F.create_map().cast("map<string, double>"))
    total = F.aggregate(F.map_values(dims), F.lit(0.0), lambda a, x: a + x)
    low = F.lit(False)
    for k, floor in FLOORS.items():
        low = low | (F.coalesce(F.try_element_at(dims, F.lit(k)), F.lit(0.0)) < floor)
    clause = (
        F.when(~F.coalesce(F.col("method").isin(INDEPENDENT), F.lit(False)), "method").when(~F.col("total").eqNullSafe(total), "sum")
        .when(low, "floors").when(F.col("total") < target, "total")
    )
    return blocks.withColumns({"ships": clause.isNull(), "clause": clause})


def binding_block(blocks: DataFrame, hashes: DataFrame) -> DataFrame:
    """The block that binds each skill of blocks(skill, key, total, content_sha256, invalidated, invalidated_reason and more).

    Live blocks (iter-N-live) of the content that the skill has now (hashes: skill,
    content_sha256) count; of them the least total binds, a missing one as 0, then the least
    N. An invalidated block does not count, but ends the query if it gives no reason.
    """
    bad = F.coalesce(F.col("invalidated"), F.lit(False))
    silent = bad & (F.trim(F.coalesce("invalidated_reason", F.lit(""))) == "")
    checked = blocks.withColumn("key", F.when(silent, F.raise_error(F.concat(F.lit("invalidated without a reason: "), "skill", F.lit(" "), "key"))).otherwise(F.col("key")))
    live = checked.where(F.col("key").rlike(ITERATION) & ~bad).join(hashes, ["skill", "content_sha256"])
    order = F.struct(F.coalesce("total", F.lit(0.0)), F.regexp_extract("key", ITERATION, 1).cast("int"))
    return live.groupBy("skill").agg(F.min_by(F.struct(*blocks.columns), order).alias("x")).select("x.*")


def grade(value: Column) -> Column:
    out = F.when(value >= BANDS[0][1], BANDS[0][0])
    for name, at in BANDS[1:]:
        out = out.when(value >= at, name)
    return out.otherwise("F")


def provider_bias(judgments: DataFrame) -> DataFrame:
    """Each provider's mean against the mean of all judgments."""
    every = judgments.agg(F.avg("total").alias("grand"))
    out = judgments.groupBy("provider").agg(F.avg("total").alias("mean"), F.count(F.lit(1)).alias("n"))
    return out.crossJoin(F.broadcast(every)).select("provider", "n", "mean", (F.col("mean") - F.col("grand")).alias("bias"))


def round_spread(judgments: DataFrame) -> DataFrame:
    """Means by round and how far apart they lie, for each provider."""
    rounds = judgments.groupBy("provider", "round_index").agg(F.avg("total").alias("m"))
    return rounds.groupBy("provider").agg(F.count(F.lit(1)).alias("rounds"), (F.max("m") - F.min("m")).alias("spread"))


def provider_quality(judgments: DataFrame, full: float) -> DataFrame:
    """Distinct values, spread over skill means (population), rates of multiples of five and of the full total."""
    own = judgments.groupBy("provider").agg(
        F.countDistinct("total").alias("distinct_values"),
        F.avg(F.when(F.pmod(F.col("total"), F.lit(5.0)) == 0, 1.0).otherwise(0.0)).alias("multiple_rate"),
        F.avg(F.when(F.col("total") >= full, 1.0).otherwise(0.0)).alias("full_rate"),
    )
    means = judgments.groupBy("provider", "skill").agg(F.avg("total").alias("m")).groupBy("provider").agg(F.stddev_pop("m").alias("skill_sd"), F.count(F.lit(1)).alias("skills"))
    return own.join(means, "provider")


def dimension_quality(judgments: DataFrame, maxima: dict[str, int] | None = None) -> DataFrame:
    """Signals of each provider over judgments(skill, provider, round_index, total, scores map), as judge_verdict reads them.

    distinct_values, multiple_rate and max_rate are over dimension scores (null where none was
    recorded), max_rate over those of known dimensions; full_rate over totals; skill_sd is the
    population deviation of skill means, null for fewer than FEW_SKILLS skills. Consistency:
    spread_mean and spread_max within a skill, within_sd (mean of sample deviations), and
    round_spread over round means.
    """
    maxima = maxima or MAXIMA
    top = F.create_map(*(x for k, v in maxima.items() for x in (F.lit(k), F.lit(float(v)))))
    rate = lambda hit: F.avg(F.when(hit, 1.0).otherwise(0.0))
    most = F.try_element_at(top, F.col("dim"))
    dims = judgments.select("provider", F.explode("scores").alias("dim", "score")).groupBy("provider").agg(
        F.count(F.lit(1)).alias("scores"), F.count_distinct("score").alias("distinct_values"), rate(F.pmod(F.col("score"), F.lit(5.0)) == 0).alias("multiple_rate"),
        F.avg(F.when(most.isNotNull(), F.when(F.col("score") >= most, 1.0).otherwise(0.0))).alias("max_rate"),
    )
    totals = judgments.groupBy("provider").agg(F.count(F.lit(1)).alias("n"), rate(F.col("total") >= float(sum(maxima.values()))).alias("full_rate"))
    by_skill = judgments.groupBy("provider", "skill").agg(F.avg("total").alias("m"), (F.max("total") - F.min("total")).alias("spread"), F.stddev_samp("total").alias("sd"))
    skills = by_skill.groupBy("provider").agg(
        F.count(F.lit(1)).alias("skills"), F.when(F.count(F.lit(1)) >= FEW_SKILLS, F.stddev_pop("m")).alias("skill_sd"), F.avg("spread").alias("spread_mean"), F.max("spread").alias("spread_max"), F.avg("sd").alias("within_sd")
    )
    rounds = judgments.groupBy("provider", "round_index").agg(F.avg("total").alias("m")).groupBy("provider").agg((F.max("m") - F.min("m")).alias("round_spread"))
    return totals.join(skills, "provider").join(rounds, "provider").join(dims, "provider", "left").na.fill(0, ["scores"])


def pool_figures(judgments: DataFrame) -> DataFrame:
    """One row: n_judgments, providers, skills, pooled_mean, bias_spread, sigma_min, sigma_max, sigma_median, and the bars that these imply.

    All figures but n_judgments are null where a skill has fewer than two judgments. implied_min
    and implied_max are what the spread clause asked of a mean, sem_bar what the bound asks at
    the median sigma and the median number of judgments.
    """
    by_skill = judgments.groupBy("skill").agg(F.count("total").alias("n"), F.stddev_samp("total").alias("sigma"), F.sum("total").alias("s"))
    skills = by_skill.agg(
        F.sum("n").alias("n_judgments"), F.count(F.lit(1)).alias("skills"), (F.sum("s") / F.sum("n")).alias("pooled_mean"), F.min("sigma").alias("sigma_min"), F.max("sigma").alias("sigma_max"),
        F.median("sigma").alias("sigma_median"), F.median("n").alias("n_median"), F.min("n").alias("least"),
    )
    own = judgments.groupBy("provider").agg(F.avg("total").alias("m")).agg(F.count(F.lit(1)).alias("providers"), (F.max("m") - F.min("m")).alias("bias_spread"))
    out = skills.crossJoin(F.broadcast(own))  # of one row
    told = lambda c: F.when(F.col("least") >= 2, c)
    return out.select(
        F.coalesce("n_judgments", F.lit(0)).alias("n_judgments"), "providers", "skills", *(told(F.col(c)).alias(c) for c in ("pooled_mean", "bias_spread", "sigma_min", "sigma_max", "sigma_median")),
        told(LOWER + F.col("sigma_min")).alias("implied_min"), told(LOWER + F.col("sigma_max")).alias("implied_max"), told(TARGET + K * F.col("sigma_median") / F.sqrt("n_median")).alias("sem_bar"),
    )


def exclusion_effect(judgments: DataFrame, flagged: DataFrame) -> DataFrame:
    """pool_figures with and without the flagged providers (provider), and the difference: a row for each pool (with, without, delta)."""
    kept = judgments.join(flagged, "provider", "left_anti")
    both = pool_figures(judgments).withColumn("pool", F.lit("with")).unionByName(pool_figures(kept).withColumn("pool", F.lit("without")))
    figures = ["n_judgments", "pooled_mean", "bias_spread", "sigma_min", "sigma_max", "sigma_median"]
    delta = both.agg(*(F.sum(F.when(F.col("pool") == "without", F.col(c)).otherwise(-F.col(c))).alias(c) for c in figures)).withColumn("pool", F.lit("delta"))
    whole = both.agg(F.count("pooled_mean").alias("n")).where("n = 2")  # a difference needs both
    return both.select("pool", *figures).unionByName(delta.crossJoin(F.broadcast(whole)).select("pool", *figures))


def judge_verdict(q: DataFrame) -> DataFrame:
    """Does a judge tell skills apart? Too few skills come first, then flat, then coarse or saturated judges.

    q is as from provider_quality; a column max_rate (scores at their dimension's maximum)
    counts too where q has it.
    """
    top = F.col("full_rate") >= TOP_RATE
    if "max_rate" in q.columns:
        top = top | (F.coalesce("max_rate", F.lit(0.0)) >= TOP_RATE)
    label = (
        F.when(F.col("skills") < FEW_SKILLS, "INSUFFICIENT-DATA")
        .when((F.col("distinct_values") < FEW_VALUES) | (F.col("skill_sd") < LOW_SPREAD), "NON-DISCRIMINATING")
        .when(top | (F.col("multiple_rate") >= ROUND_RATE), "COARSE")
        .otherwise("DISCRIMINATING")
    )
    return q.withColumn("verdict", label)


def chance_rate(maximum: Column) -> Column:
    """Share of the integers 0 to maximum that are multiples of five."""
    return (F.floor(maximum / 5) + 1) / (maximum + 1)


def leave_one_out(judgments: DataFrame) -> DataFrame:
    """Statistics of every skill without each judge in turn (skill, left_out, n, mean, ci_lower).

    Sums of the whole less a judge's own give count, mean and deviation, so no row is
    paired with the judges that did not make it.
    """
    sums = [F.count("total").alias("n"), F.sum("total").alias("s"), F.sum(F.col("total") * F.col("total")).alias("q")]
    own = judgments.groupBy("skill", "provider").agg(*sums)
    whole = own.groupBy("skill").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    judges = judgments.select(F.col("provider").alias("left_out")).distinct()
    each = whole.crossJoin(F.broadcast(judges))
    mine = own.select("skill", F.col("provider").alias("left_out"), *(F.col(c).alias(f"own_{c}") for c in "nsq"))
    j = each.join(mine, ["skill", "left_out"], "left")
    n, s, q = (F.col(c) - F.coalesce(f"own_{c}", F.lit(0)) for c in "nsq")
    var = F.greatest((q - s * s / n) / (n - 1), F.lit(0.0))
    out = j.select("skill", "left_out", n.alias("n"), F.try_divide(s, n).alias("mean"), F.when(n > 1, F.sqrt(var)).alias("stdev"))
    return out.withColumn("ci_lower", F.col("mean") - K * F.col("stdev") / F.sqrt("n"))


def newly_blocked(measured: DataFrame, without: DataFrame) -> DataFrame:
    """Skills that ship as measured and not without some judge."""
    ok = measured.where("ships").select("skill")
    return without.where("NOT ships").join(ok, "skill", "left_semi").select("skill", "left_out")


def provider_rounds(judgments: DataFrame) -> DataFrame:
    """Each provider's own round: the how-manieth judgment of the skill it is."""
    w = W.partitionBy("skill", "provider").orderBy("pos")
    return judgments.withColumn("round_index", F.row_number().over(w) - 1)


def rounds_from_order(judgments: DataFrame) -> DataFrame:
    """Rounds read from the record: a provider whose place on the roster is not after its predecessor's opens one."""
    w = W.partitionBy("skill").orderBy("pos")
    opens = F.when(F.lag("roster_ix").over(w) < F.col("roster_ix"), 0).otherwise(1)
    return judgments.withColumn("_open", opens).withColumn("segment", F.sum("_open").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1).drop("_open")


def missing_attempts(judgments: DataFrame, skills: DataFrame, providers: DataFrame, rounds: int) -> DataFrame:
    """The attempts (skill, provider, round_index) that left no judgment."""
    grid = skills.crossJoin(F.broadcast(providers)).crossJoin(F.broadcast(skills.sparkSession.range(rounds).select(F.col("id").cast("int").alias("round_index"))))
    return grid.join(judgments.select("skill", "provider", "round_index"), ["skill", "provider", "round_index"], "left_anti")


def reconcile(recorded: DataFrame, derived: DataFrame, *key: str) -> DataFrame:
    """Keys whose numbers of recorded and derived rows differ."""
    a = recorded.groupBy(*key).agg(F.count(F.lit(1)).alias("recorded"))
    b = derived.groupBy(*key).agg(F.count(F.lit(1)).alias("derived"))
    out = a.join(b, list(key), "full_outer").na.fill(0, ["recorded", "derived"])
    return out.where("recorded <> derived")


def impute(missing: DataFrame, judgments: DataFrame) -> DataFrame:
    """A provider's own mean over the skill for each missing attempt; null if it has none."""
    own = judgments.groupBy("skill", "provider").agg(F.avg("total").alias("total"))
    return missing.join(own, ["skill", "provider"], "left")


def attempts(judgments: DataFrame, expected: int) -> DataFrame:
    """Attempted, pooled and refused by skill."""
    out = judgments.groupBy("skill").agg(F.count(F.lit(1)).alias("pooled"))
    return out.select("skill", F.lit(expected).alias("attempted"), "pooled", (F.lit(expected) - F.col("pooled")).alias("refused"))
