"""Queries of scoring, judge panels, paired evaluations, routing, studies and integrity over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import evals, integrity, markdown, panel, routing, scoring, studies
from plumbline.plans.bindings import ARMS_SQL, CASES_SQL, JUDGMENTS_SQL, Registry, arms, cases, judgments, table

R = Registry()
_CONF = "count(*) FILTER (WHERE expected AND predicted) AS tp, count(*) FILTER (WHERE NOT expected AND predicted) AS fp, count(*) FILTER (WHERE expected AND NOT predicted) AS fn, count(*) FILTER (WHERE NOT expected AND NOT predicted) AS tn"
_METR = "coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) AS f1"
_C = f"WITH c AS ({CASES_SQL})"


@R.query(f"{_C}, m AS (SELECT category, {_CONF} FROM c GROUP BY 1) SELECT *, {_METR} FROM m")
def confusion_by_source(spark, d):
    return scoring.score(cases(spark, d), "category")


@R.query(f"{_C}, m AS (SELECT check_id, {_CONF} FROM c GROUP BY 1), x AS (SELECT *, {_METR} FROM m) SELECT *, CASE WHEN f1 >= 0.8 THEN 'pass' ELSE 'fail' END AS status FROM x")
def f1_gate(spark, d):
    return scoring.gate(scoring.score(cases(spark, d), "check_id"))


@R.query(f"{_C}, m AS (SELECT check_id, {_CONF}, count(DISTINCT predicted) AS v FROM c GROUP BY 1) SELECT * EXCLUDE (v), {_METR}, fp = 0 AND fn = 0 AND v = 2 AS discriminates FROM m")
def f1_by_check(spark, d):
    return scoring.per_check(cases(spark, d))


@R.query(f"{_C}, m AS (SELECT category, check_id, {_CONF} FROM c GROUP BY GROUPING SETS ((category, check_id), (category))) SELECT *, {_METR} FROM m")
def micro_f1_grouping_sets(spark, d):
    return scoring.score_sets(cases(spark, d), ("category", "check_id"), ("category",))


@R.query(f"{_C} SELECT category, count(*) FILTER (WHERE NOT expected AND predicted) AS leaked, count(*) FILTER (WHERE expected) AS vulnerable, count(*) FILTER (WHERE NOT expected) AS clean FROM c GROUP BY 1")
def clean_leakage(spark, d):
    return scoring.leakage(cases(spark, d), "category")


_SETS = "SELECT conv_id, list_distinct(list(role)) AS detected, CASE WHEN conv_id % 3 = 0 THEN ['user', 'system'] ELSE ['user', 'tool'] END AS expected, ['user', 'assistant', 'system'] AS static FROM conversations GROUP BY conv_id"


@R.query(
    f"WITH s AS ({_SETS}), w AS (SELECT *, list_intersect(expected, static) AS want FROM s) SELECT conv_id, len(list_intersect(want, detected))::INTEGER AS tp, len(list_filter(detected, lambda x: NOT list_contains(want, x)))::INTEGER AS fp, len(list_filter(want, lambda x: NOT list_contains(detected, x)))::INTEGER AS fn FROM w"
)
def set_f1(spark, d):
    s = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("detected"))
    lits = lambda *x: F.array(*(F.lit(i) for i in x))
    want = F.when(F.col("conv_id") % 3 == 0, lits("user", "system")).otherwise(lits("user", "tool"))
    return s.select("conv_id", *scoring.set_f1(want, lits("user", "assistant", "system"), F.col("detected")))


@R.query(f"{_C}, g AS (SELECT category, CASE WHEN count(DISTINCT check_id) = 1 THEN min(check_id) ELSE 'mixed-proxy' END AS scope, count(DISTINCT check_id) AS checks, count(*) AS n FROM c GROUP BY 1) SELECT category, scope, greatest(6, 2 * checks) AS floor, n >= greatest(6, 2 * checks) AS enough FROM g")
def scope_and_floor(spark, d):
    g = cases(spark, d).groupBy("category").agg(scoring.scope_label(F.col("check_id")).alias("scope"), F.countDistinct("check_id").alias("checks"), F.count(F.lit(1)).alias("n"))
    floor = scoring.floor_of(F.col("checks"))
    return g.select("category", "scope", floor.alias("floor"), (F.col("n") >= floor).alias("enough"))


_J = f"WITH j AS ({JUDGMENTS_SQL})"
_POOL = "count(total) AS n, avg(total) AS mean, median(total) AS median, min(total) AS min, max(total) AS max, stddev_samp(total) AS stdev"


@R.query(f"{_J}, p AS (SELECT skill, {_POOL} FROM j GROUP BY 1) SELECT *, max - min AS range, mean - stdev AS lower_bound, stdev / sqrt(n) AS sem, mean - stdev / sqrt(n) AS ci_lower FROM p")
def pooled_stats(spark, d):
    return panel.pooled(judgments(spark, d), "skill")


@R.query(f"{_J}, g AS (SELECT avg(total) AS grand FROM j) SELECT provider, count(*) AS n, avg(total) AS mean, avg(total) - (SELECT grand FROM g) AS bias FROM j GROUP BY 1")
def provider_bias(spark, d):
    return panel.provider_bias(judgments(spark, d))


_ROUNDED = "r AS (SELECT skill, provider, pos, total, count(*) OVER (PARTITION BY skill, provider ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS round_index FROM j)"


@R.query(f"{_J}, {_ROUNDED} SELECT skill, provider, pos, round_index FROM r")
def provider_round_index(spark, d):
    return panel.provider_rounds(judgments(spark, d)).select("skill", "provider", "pos", "round_index")


@R.query(f"{_J}, o AS (SELECT *, CASE WHEN lag(roster_ix) OVER w < roster_ix THEN 0 ELSE 1 END AS op FROM j WINDOW w AS (PARTITION BY skill ORDER BY pos)) SELECT skill, pos, (sum(op) OVER (PARTITION BY skill ORDER BY pos))::BIGINT - 1 AS segment FROM o")
def rounds_from_order(spark, d):
    return panel.rounds_from_order(judgments(spark, d)).select("skill", "pos", "segment")


@R.query(f"{_J}, {_ROUNDED}, m AS (SELECT provider, round_index % 5 AS b, avg(total) AS m FROM r GROUP BY ALL) SELECT provider, count(*) AS rounds, max(m) - min(m) AS spread FROM m GROUP BY 1")
def round_means(spark, d):
    j = panel.provider_rounds(judgments(spark, d)).withColumn("round_index", F.col("round_index") % 5)
    return panel.round_spread(j)


@R.query(f"{_J}, p AS (SELECT skill, provider, {_POOL} FROM j GROUP BY ALL) SELECT skill, provider, n, mean, stdev, mean - stdev / sqrt(n) AS ci_lower FROM p")
def skill_dispersion(spark, d):
    return panel.pooled(judgments(spark, d), "skill", "provider").select("skill", "provider", "n", "mean", "stdev", "ci_lower")


_QUALITY = (
    f"{_J}, r AS (SELECT skill, provider, round(total) AS total FROM j), o AS (SELECT provider, count(DISTINCT total) AS distinct_values, avg(CASE WHEN total % 5 = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS multiple_rate, avg(CASE WHEN total >= 100 THEN 1.0 ELSE 0.0 END)::DOUBLE AS full_rate FROM r GROUP BY 1), "
    "m AS (SELECT provider, skill, avg(total) AS m FROM r GROUP BY ALL), s AS (SELECT provider, stddev_pop(m) AS skill_sd, count(*) AS skills FROM m GROUP BY 1)"
)


def _whole(spark, d):
    return judgments(spark, d).withColumn("total", F.round("total"))


@R.query(f"{_QUALITY} SELECT * FROM o JOIN s USING (provider)")
def provider_quality(spark, d):
    return panel.provider_quality(_whole(spark, d), 100.0)


_JUDGES = "CASE provider WHEN 'p1' THEN 5.0 WHEN 'p2' THEN 5 * (pos % 7) WHEN 'p3' THEN 90 + pos % 11 ELSE round(total) END"


@R.query(
    f"{_QUALITY.replace('round(total) AS total FROM j', f'({_JUDGES})::DOUBLE AS total FROM j WHERE provider <> {chr(39)}p4{chr(39)} OR skill = {chr(39)}view{chr(39)}')} "
    "SELECT provider, CASE WHEN skills < 2 THEN 'INSUFFICIENT-DATA' WHEN distinct_values < 4 OR skill_sd < 1.0 THEN 'NON-DISCRIMINATING' WHEN full_rate >= 0.5 OR multiple_rate >= 0.6 THEN 'COARSE' ELSE 'DISCRIMINATING' END AS verdict FROM o JOIN s USING (provider)"
)
def judge_verdict(spark, d):
    """Judges of several habits: one value, multiples of five, a narrow range, one skill alone, and as recorded."""
    p, pos = F.col("provider"), F.col("pos")
    total = F.when(p == "p1", 5.0).when(p == "p2", 5 * (pos % 7)).when(p == "p3", 90 + pos % 11).otherwise(F.round("total"))
    j = judgments(spark, d).where("provider <> 'p4' OR skill = 'view'").withColumn("total", total.cast("double"))
    return panel.judge_verdict(panel.provider_quality(j, 100.0)).select("provider", "verdict")


_SCORED = (
    f"{_J}, r AS (SELECT *, row_number() OVER (PARTITION BY skill, provider ORDER BY pos) - 1 AS round_index FROM j), d AS (SELECT provider, skill, pos, unnest(['D1', 'D4', 'D7', 'D9']) AS dim, unnest([pos % 21, pos % 5 + 11, CASE WHEN provider = 'p1' THEN 10 ELSE pos % 11 END, 3]) AS score FROM j WHERE provider <> 'p5'), "
    "top(dim, most) AS (VALUES " + ", ".join(f"('{k}', {v})" for k, v in panel.MAXIMA.items()) + "), "
    "a AS (SELECT provider, count(*) AS scores, count(DISTINCT score) AS distinct_values, avg((score % 5 = 0)::INTEGER) AS multiple_rate, avg((score >= most)::INTEGER) AS max_rate FROM d LEFT JOIN top USING (dim) GROUP BY 1), "
    "s AS (SELECT provider, skill, avg(total) AS m, max(total) - min(total) AS spread, stddev_samp(total) AS sd FROM j GROUP BY 1, 2), b AS (SELECT provider, count(*) AS skills, stddev_pop(m) AS skill_sd, avg(spread) AS spread_mean, max(spread) AS spread_max, avg(sd) AS within_sd FROM s GROUP BY 1), "
    "q AS (SELECT provider, max(m) - min(m) AS round_spread FROM (SELECT provider, round_index, avg(total) AS m FROM r GROUP BY 1, 2) GROUP BY 1), t AS (SELECT provider, count(*) AS n, avg((total >= 120)::INTEGER) AS full_rate FROM j GROUP BY 1)"
)


@R.query(f"{_SCORED} SELECT * REPLACE (coalesce(scores, 0) AS scores) FROM t JOIN b USING (provider) JOIN q USING (provider) LEFT JOIN a USING (provider)")
def dimension_quality(spark, d):
    """What each judge's dimension scores and totals tell of it; one judge recorded no dimensions, and one dimension has no maximum."""
    pos, given = F.col("pos"), F.col("provider") != "p5"
    tops = F.when(F.col("provider") == "p1", 10).otherwise(pos % 11)
    scores = F.create_map(*(x for k, v in (("D1", pos % 21), ("D4", pos % 5 + 11), ("D7", tops), ("D9", F.lit(3))) for x in (F.lit(k), v.cast("double"))))
    return panel.dimension_quality(panel.provider_rounds(judgments(spark, d)).withColumn("scores", F.when(given, scores)))


_POOL = (
    "SELECT sum(n)::BIGINT AS n_judgments, sum(s) / sum(n) AS pooled_mean, (SELECT max(m) - min(m) FROM (SELECT avg(total) AS m FROM {0} GROUP BY provider)) AS bias_spread, min(sd) AS sigma_min, max(sd) AS sigma_max, median(sd) AS sigma_median "
    "FROM (SELECT skill, count(*) AS n, sum(total) AS s, stddev_samp(total) AS sd FROM {0} GROUP BY 1)"
)


@R.query(
    f"{_J}, k AS (SELECT * FROM j WHERE provider NOT IN ('p1', 'p3')), w AS ({_POOL.format('j')}), o AS ({_POOL.format('k')}) SELECT 'with' AS pool, * FROM w UNION ALL SELECT 'without', * FROM o UNION ALL "
    "SELECT 'delta', o.n_judgments - w.n_judgments, o.pooled_mean - w.pooled_mean, o.bias_spread - w.bias_spread, o.sigma_min - w.sigma_min, o.sigma_max - w.sigma_max, o.sigma_median - w.sigma_median FROM w, o"
)
def exclusion_effect(spark, d):
    """The panel's figures with and without two of its judges."""
    return panel.exclusion_effect(judgments(spark, d), spark.createDataFrame([("p1",), ("p3",)], "provider string"))


@R.query(
    f"{_J}, w AS ({_POOL.format('j')}) SELECT n_judgments, (SELECT count(DISTINCT provider) FROM j) AS providers, (SELECT count(DISTINCT skill) FROM j) AS skills, pooled_mean, bias_spread, sigma_min, sigma_max, sigma_median, 105 + sigma_min AS implied_min, "
    "105 + sigma_max AS implied_max, 108 + sigma_median / sqrt((SELECT median(n) FROM (SELECT count(*) AS n FROM j GROUP BY skill))) AS sem_bar FROM w"
)
def panel_summary(spark, d):
    """The panel in one row, and the bars that its spread implies."""
    return panel.pool_figures(judgments(spark, d))


_DIMS = "(VALUES " + ", ".join(f"('{k}', {panel.FLOORS[k]}, {panel.MAXIMA[k]})" for k in panel.FLOORS) + ") AS dims(dim, floor, maximum)"


_AGG = (
    f"{_J}, c AS (SELECT skill || '-' || (pos % 25) AS card, any_value(skill) AS skill, any_value(pos % 25) AS k, list(90 + floor(total) ORDER BY pos)[:12] AS t FROM j GROUP BY 1), "
    "s AS (SELECT *, CASE WHEN k = 3 THEN t[:3] WHEN k IN (6, 9) THEN [112.0, 113.0, 112.0, 112.0] ELSE t END AS totals FROM c), "
    "f AS (SELECT *, len(totals) AS n, round_even(list_avg(totals), 1) AS mean, round_even(list_stddev_samp(totals), 2) AS stdev FROM s), "
    "g AS (SELECT *, round_even(stdev / sqrt(n), 2) AS sem FROM f), h AS (SELECT *, round_even(mean - sem, 1) AS ci FROM g)"
)
_CLAUSE = (
    "CASE WHEN k = 1 THEN 'method' WHEN k = 2 THEN 'rubric' WHEN n < 4 THEN 'rounds' WHEN k = 4 THEN 'missing-statistics' WHEN k = 5 THEN 'drift' "
    "WHEN k = 6 THEN 'floors' WHEN mean < 108 THEN 'mean' WHEN ci < 108 THEN 'bound' END"
)


@R.query(f"{_AGG} SELECT card, {_CLAUSE} AS clause, {_CLAUSE} IS NULL AS ships, n::DOUBLE AS n FROM h".replace("round_even", "round"))
def ship_verdict(spark, d):
    """Cards of a skill's judgments, each held against all clauses of the gate in order; some cards have something wrong with them."""
    k = (F.col("pos") % 25).alias("k")
    drawn = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", "total"))), lambda x: 90 + F.floor(x["total"]).cast("double")), 1, 12)
    c = judgments(spark, d).groupBy(F.concat_ws("-", "skill", F.col("pos") % 25).alias("card"), k).agg(drawn.alias("totals"))
    good = F.array(*map(F.lit, (112.0, 113.0, 112.0, 112.0)))
    c = c.withColumn("totals", F.when(F.col("k") == 3, F.slice("totals", 1, 3)).when(F.col("k").isin(6, 9), good).otherwise(F.col("totals")))
    none = F.lit(None).cast("map<string,double>")
    cards = c.select("card", "k", "totals", F.when(F.col("k") == 1, "other").otherwise(panel.METHOD).alias("method"), F.when(F.col("k") == 2, "0").otherwise(panel.RUBRIC).alias("rubric_sha"), none.alias("stored"), none.alias("dim_means"))
    figures = panel.card_figures(cards)
    stored = F.create_map(*(x for n in (*panel.STORED, *panel.LATER) for x in (F.lit(n), F.col(n))))
    stored = F.when(F.col("k") == 4, F.map_filter(stored, lambda n, _: n != "median")).when(F.col("k") == 5, F.map_concat(F.map_filter(stored, lambda n, _: n != "max"), F.create_map(F.lit("max"), F.lit(0.0)))).otherwise(stored)
    dims = F.create_map(*(x for n, m in panel.MAXIMA.items() for x in (F.lit(n), F.lit(float(m)))))
    dims = F.when(F.col("k") == 6, F.map_filter(dims, lambda n, _: n != "D3")).otherwise(dims)
    return panel.ship_verdict(figures.select("card", "k", "totals", "method", "rubric_sha", stored.alias("stored"), dims.alias("dim_means"))).select("card", "clause", "ships", "n")


def _dims(spark):
    return spark.createDataFrame([(k, panel.FLOORS[k], panel.MAXIMA[k]) for k in panel.FLOORS], "dim string, floor int, maximum int")


@R.query(f"{_J}, m AS (SELECT provider, 'D' || (pos % 8 + 1) AS dim, max(floor(total))::INTEGER AS maximum FROM j GROUP BY ALL) SELECT provider, avg((maximum // 5 + 1)::DOUBLE / (maximum + 1)) AS rate FROM m GROUP BY 1")
def chance_rate(spark, d):
    """How often each judge would meet a multiple of five by chance, over the ranges that its dimensions have."""
    most = judgments(spark, d).groupBy("provider", F.concat(F.lit("D"), F.col("pos") % 8 + 1).alias("dim")).agg(F.max(F.floor("total")).cast("int").alias("maximum"))
    return most.groupBy("provider").agg(F.avg(panel.chance_rate(F.col("maximum"))).alias("rate"))


@R.query(f"{_J}, x AS (SELECT skill, 'D' || (pos % 8 + 1) AS dim, avg(total) AS mean FROM j GROUP BY ALL), g AS (SELECT skill, dim, mean - floor AS gap FROM x JOIN {_DIMS} USING (dim)) SELECT skill, arg_min(dim, gap) AS dim, min(gap) AS gap FROM g GROUP BY 1")
def lowest_dimension(spark, d):
    means = judgments(spark, d).groupBy("skill", F.concat(F.lit("D"), F.col("pos") % 8 + 1).alias("dim")).agg(F.avg("total").alias("mean"))
    return panel.lowest_dimension(means, _dims(spark))


_GATE = "CASE WHEN n < 4 THEN 'too-few-judgments' WHEN mean IS NULL OR ci_lower IS NULL THEN 'missing-statistics' WHEN mean < 49 THEN 'mean-below-target' WHEN ci_lower < 49 THEN 'bound-below-target' ELSE 'ships' END"


@R.query(f"{_J}, p AS (SELECT skill, count(*) AS n, avg(total) AS mean, avg(total) - stddev_samp(total) / sqrt(count(*)) AS ci_lower FROM j GROUP BY 1), v AS (SELECT skill, {_GATE} AS verdict_reason FROM p) SELECT *, verdict_reason = 'ships' AS ships FROM v")
def ship_gate(spark, d):
    return panel.ship_gate(panel.pooled(judgments(spark, d), "skill"), 49.0).select("skill", "verdict_reason", "ships")


@R.query("SELECT event_id, CASE WHEN value >= 108 THEN 'A' WHEN value >= 96 THEN 'B' WHEN value >= 84 THEN 'C' WHEN value >= 72 THEN 'D' ELSE 'F' END AS grade FROM events")
def grade_band(spark, d):
    return table(spark, d, "events").select("event_id", panel.grade(F.col("value")).alias("grade"))


_LOO = f"{_J}, p AS (SELECT DISTINCT provider AS left_out FROM j), l AS (SELECT skill, left_out, count(*) AS n, avg(total) AS mean, stddev_samp(total) AS stdev FROM j, p WHERE provider <> left_out GROUP BY ALL), x AS (SELECT *, mean - stdev / sqrt(n) AS ci_lower FROM l)"


@R.query(f"{_LOO} SELECT skill, left_out, n, mean, stdev, ci_lower FROM x")
def leave_one_out(spark, d):
    return panel.leave_one_out(judgments(spark, d)).select("skill", "left_out", "n", "mean", "stdev", "ci_lower")


_VERDICT = "CASE WHEN {0}.n < 4 THEN 0 WHEN {0}.mean < 48.25 OR {0}.ci_lower < 48.25 THEN 0 ELSE 1 END"


@R.query(
    f"{_LOO}, m AS (SELECT skill, count(*) AS n, avg(total) AS mean, avg(total) - stddev_samp(total) / sqrt(count(*)) AS ci_lower FROM j GROUP BY 1) "
    f"SELECT x.skill, x.left_out FROM x JOIN m USING (skill) WHERE {_VERDICT.format('m')} = 1 AND {_VERDICT.format('x')} = 0"
)
def newly_blocked(spark, d):
    j = judgments(spark, d)
    return panel.newly_blocked(panel.ship_gate(panel.pooled(j, "skill"), 48.25), panel.ship_gate(panel.leave_one_out(j), 48.25))


_SPARSE = "s AS (SELECT * FROM r WHERE round_index < 20 AND pos % 7 <> 0)"
_GRID = "g AS (SELECT * FROM (SELECT DISTINCT skill FROM j), (SELECT DISTINCT provider FROM j), (SELECT unnest(range(20)) AS round_index))"


def _sparse(spark, d):
    return panel.provider_rounds(judgments(spark, d)).where("round_index < 20 AND pos % 7 <> 0")


def _missing(spark, d):
    j = judgments(spark, d)
    return panel.missing_attempts(_sparse(spark, d), j.select("skill").distinct(), j.select("provider").distinct(), 20)


@R.query(f"{_J}, {_ROUNDED}, {_SPARSE}, {_GRID} SELECT g.skill, g.provider, g.round_index FROM g LEFT JOIN s ON g.skill = s.skill AND g.provider = s.provider AND g.round_index = s.round_index WHERE s.skill IS NULL")
def missing_attempts(spark, d):
    return _missing(spark, d)


@R.query(f"{_J}, {_ROUNDED}, {_SPARSE}, {_GRID}, m AS (SELECT g.skill, g.provider, g.round_index FROM g LEFT JOIN s ON g.skill = s.skill AND g.provider = s.provider AND g.round_index = s.round_index WHERE s.skill IS NULL), o AS (SELECT skill, provider, avg(total) AS total FROM s GROUP BY ALL) SELECT skill, provider, round_index, total FROM m LEFT JOIN o USING (skill, provider)")
def impute_missing(spark, d):
    return panel.impute(_missing(spark, d), _sparse(spark, d)).select("skill", "provider", "round_index", "total")


@R.query(f"{_J}, {_ROUNDED}, {_SPARSE} SELECT skill, 120 AS attempted, count(*) AS pooled, 120 - count(*) AS refused FROM s GROUP BY 1")
def attempt_totals(spark, d):
    return panel.attempts(_sparse(spark, d), 120)


@R.query(f"{_J}, {_ROUNDED}, {_SPARSE}, {_GRID}, m AS (SELECT skill, provider, count(*) AS derived FROM (SELECT g.skill, g.provider, g.round_index FROM g LEFT JOIN s ON g.skill = s.skill AND g.provider = s.provider AND g.round_index = s.round_index WHERE s.skill IS NULL) GROUP BY ALL), c AS (SELECT skill, provider, count(*) AS recorded FROM r WHERE round_index < 20 AND pos % 7 = 0 AND pos % 2 = 0 GROUP BY ALL) SELECT skill, provider, coalesce(recorded, 0) AS recorded, coalesce(derived, 0) AS derived FROM c FULL JOIN m USING (skill, provider) WHERE coalesce(recorded, 0) <> coalesce(derived, 0)")
def refusal_reconcile(spark, d):
    recorded = panel.provider_rounds(judgments(spark, d)).where("round_index < 20 AND pos % 7 = 0 AND pos % 2 = 0")
    return panel.reconcile(recorded, _missing(spark, d), "skill", "provider")


_A = f"WITH a AS ({ARMS_SQL})"
_PAIRS = "r AS (SELECT slug, arm, avg(passed::INTEGER) AS pass_rate FROM a GROUP BY ALL), p AS (SELECT coalesce(w.slug, o.slug) AS slug, w.pass_rate AS with_rate, o.pass_rate AS without_rate FROM (SELECT * FROM r WHERE arm = 'with') w FULL JOIN (SELECT * FROM r WHERE arm = 'without') o ON w.slug = o.slug)"


def _pairs(spark, d):
    return evals.pair_arms(evals.arm_rates(arms(spark, d)))


@R.query(f"{_A}, {_PAIRS}, b AS (SELECT *, with_rate IS NOT NULL AND without_rate IS NOT NULL AS has_both FROM p) SELECT slug % 3 + 1 AS iteration, count(*) FILTER (WHERE has_both) AS paired, count(*) FILTER (WHERE NOT has_both) AS excluded, avg(with_rate) FILTER (WHERE has_both) AS with_mean, avg(without_rate) FILTER (WHERE has_both) AS without_mean, stddev_samp(with_rate) FILTER (WHERE has_both) AS with_sd, stddev_samp(without_rate) FILTER (WHERE has_both) AS without_sd, avg(with_rate) FILTER (WHERE has_both) - avg(without_rate) FILTER (WHERE has_both) AS delta FROM b GROUP BY 1")
def paired_delta(spark, d):
    return evals.paired_delta(_pairs(spark, d).withColumn("iteration", F.col("slug") % 3 + 1), "iteration")


@R.query(f"{_A}, {_PAIRS} SELECT slug, with_rate IS NULL AS no_with FROM p WHERE with_rate IS NULL OR without_rate IS NULL")
def excluded_pairs(spark, d):
    return _pairs(spark, d).where("with_rate IS NULL OR without_rate IS NULL").select("slug", F.col("with_rate").isNull().alias("no_with"))


@R.query(f"{_A}, g AS (SELECT slug, idx, bool_and(passed) FILTER (WHERE arm = 'with') AS wa, bool_or(passed) FILTER (WHERE arm = 'with') AS wo, bool_and(passed) FILTER (WHERE arm = 'without') AS oa, bool_or(passed) FILTER (WHERE arm = 'without') AS oo FROM a GROUP BY ALL) SELECT slug, idx, CASE WHEN wa IS NULL OR oa IS NULL THEN 'incomplete' WHEN wa AND oa THEN 'passed_in_both' WHEN NOT wo AND NOT oo THEN 'failed_in_both' WHEN wa AND NOT oo THEN 'passed_with_failed_without' WHEN NOT wo AND oa THEN 'failed_with_passed_without' ELSE 'mixed_across_repeats' END AS bucket FROM g")
def assertion_bucket(spark, d):
    return evals.assertion_buckets(arms(spark, d))


def _outputs():
    """A turn's text as the one file of a run."""
    return F.create_map(F.lit("notes.md"), F.coalesce("text", F.lit("")))


_LINES = "len(string_split(t, chr(10))) - (t = '' OR suffix(t, chr(10)))::INTEGER"


@R.query(
    "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN false WHEN 1 THEN length(trim(regexp_replace(left(t, 60), '\\s+', ' ', 'g'), ' ')) >= 24 "
    f"WHEN 2 THEN trim(t, ' ') <> '' AND {_LINES} >= 2 ELSE trim(t, ' ') <> '' AND {_LINES} >= 1 END AS is_grounded FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations)"
)
def evidence_grounded(spark, d):
    """By turn: words that are nowhere, a stretch of the text with wider gaps, and lines that it has or may not have."""
    k = F.col("turn") % 4
    wide = F.concat(F.lit("saw: "), F.replace(F.left(F.coalesce("text", F.lit("")), F.lit(60)), F.lit(" "), F.lit("  ")))
    evidence = F.when(k == 0, "zzzz: not to be found in any of these texts").when(k == 1, wide).when(k == 2, "see notes.md:2").otherwise("see outputs/notes.md:1")
    return table(spark, d, "conversations").select("conv_id", "turn", evals.grounded(evidence, _outputs()).alias("is_grounded"))


_ASSERT = [
    'The output contains the string "the"', "the output does not contain the exact literal `xyzzy`.", "An output file named `notes.md` exists.", "Output file notes.md has exactly 1 line",
    "The output file notes.md is valid JSON", "output file other.md exists", "Reads well.",
]


@R.query(
    "WITH a(idx) AS (SELECT unnest(range(7))::INTEGER) SELECT conv_id, turn, idx, CASE idx WHEN 0 THEN contains(t, 'the') WHEN 1 THEN NOT contains(t, 'xyzzy') WHEN 2 THEN true "
    f"WHEN 3 THEN {_LINES} = 1 WHEN 4 THEN json_valid(t) WHEN 5 THEN false END AS passed FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations), a"
)
def mechanical_assertions(spark, d):
    a = spark.createDataFrame(list(enumerate(_ASSERT)), "idx int, assertion string")
    c = table(spark, d, "conversations").crossJoin(F.broadcast(a))
    return c.select("conv_id", "turn", "idx", evals.run_mechanical(evals.mechanical(F.col("assertion")), _outputs()).alias("passed"))


#: One turn in five says nothing that a rule knows; the others end with one phrase or, far apart in the table, two.
_SAID = [p for _, phrases in routing.RULES for p in phrases]


def _routed(spark, d):
    said, n = F.array(*map(F.lit, _SAID)), len(_SAID)
    k = F.col("conv_id") * 7 + F.col("turn")
    phrase = lambda i: F.get(said, (i % n).cast("int"))
    tail = F.when(k % 5 == 0, "").when(k % 3 == 0, F.concat(phrase(k), F.lit("; "), phrase(k * 11 + 5))).otherwise(F.upper(phrase(k)))
    turns = table(spark, d, "conversations").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), tail))
    return routing.route(turns)


_ROUTES = ", ".join(f"({i}, '{rule}', '{p}')" for i, (rule, phrases) in enumerate(routing.RULES) for p in phrases)
_SAID_SQL = "[" + ", ".join(f"'{p}'" for p in _SAID) + "]"
_ROUTED = (
    f"WITH c AS (SELECT *, conv_id * 7 + turn AS k, {_SAID_SQL} AS said FROM conversations), t AS (SELECT conv_id, turn, lower(coalesce(text, '') || ' ' || CASE WHEN k % 5 = 0 THEN '' "
    f"WHEN k % 3 = 0 THEN said[k % {len(_SAID)} + 1] || '; ' || said[(k * 11 + 5) % {len(_SAID)} + 1] ELSE said[k % {len(_SAID)} + 1] END) AS t FROM c), "
    f"m AS (SELECT DISTINCT conv_id, turn, ix, rule FROM t, (VALUES {_ROUTES}) v(ix, rule, phrase) WHERE contains(t.t, phrase)), "
    "r AS (SELECT conv_id, turn, list(rule ORDER BY ix) AS rules FROM m GROUP BY 1, 2), x AS (SELECT t.conv_id, t.turn, rules FROM t LEFT JOIN r USING (conv_id, turn))"
)


@R.query(f"{_ROUTED} SELECT conv_id, turn, rules[1] AS ast_id, rules IS NULL AS escalate FROM x")
def route_finding(spark, d):
    """The category that decides each turn, by the table of rules in its order."""
    return _routed(spark, d).select("conv_id", "turn", "ast_id", "escalate")


@R.query(f"{_ROUTED} SELECT conv_id, turn, coalesce(rules[2:], []) AS contributing FROM x")
def route_contributing(spark, d):
    return _routed(spark, d).select("conv_id", "turn", "contributing")


_BEFORE, _AFTER = "SELECT 'c' || p_size % 12 AS check_id FROM part WHERE p_partkey % 2 = 0", "SELECT 'c' || p_size % 12 AS check_id FROM part WHERE p_partkey % 2 = 0 AND p_size < 40"
_DELTA = f"WITH k AS (SELECT 'c' || i AS check_id, CASE WHEN i % 3 = 0 THEN 'full' ELSE 'artifact-signal-only' END AS covers FROM (SELECT unnest(range(14)) AS i)), x AS (SELECT k.*, (SELECT count(*) FROM ({_BEFORE}) b WHERE b.check_id = k.check_id) AS before, (SELECT count(*) FROM ({_AFTER}) a WHERE a.check_id = k.check_id) AS after FROM k)"


def _deltas(spark, d):
    p = table(spark, d, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("c"), F.col("p_size") % 12).alias("check_id"), "p_size")
    k = spark.range(14).select(F.concat(F.lit("c"), F.col("id")).alias("check_id"), F.when(F.col("id") % 3 == 0, "full").otherwise("artifact-signal-only").alias("covers"))
    return studies.before_after(k, p, p.where("p_size < 40"))


@R.query(f"{_DELTA} SELECT *, after - before AS delta FROM x")
def before_after_delta(spark, d):
    return _deltas(spark, d)


_EVERY = "SELECT unnest(['always', CASE WHEN p_partkey % 9 > 0 THEN 'often' END, CASE WHEN p_size < 40 THEN 'later' END, CASE WHEN p_size > 50 THEN 'never' END]) AS check_id FROM part"


@R.query(f"WITH f AS ({_EVERY}) SELECT check_id FROM f WHERE check_id IS NOT NULL GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM part)")
def universal_checks(spark, d):
    """Checks that fire on every package in both states; parts are the packages, and one of four checks is such."""
    p = table(spark, d, "part")
    named = F.array(F.lit("always"), F.when(F.col("p_partkey") % 9 > 0, "often"), F.when(F.col("p_size") < 40, "later"), F.when(F.col("p_size") > 50, "never"))
    after = p.select(F.explode(F.array_compact(named)).alias("check_id"))
    roster = spark.createDataFrame([(c,) for c in ("always", "often", "later", "never")], "check_id string")
    before = after.unionByName(p.where("p_size >= 40").select(F.lit("later").alias("check_id")))
    return studies.universal(studies.before_after(roster, before, after), p.count()).select("check_id")


@R.query(f"{_DELTA}, f AS (SELECT count(*) AS checks, sum(before)::BIGINT AS before, sum(after)::BIGINT AS after FROM x WHERE covers = 'full') SELECT checks, checks * 1000 AS runs, before, after, after::DOUBLE / (checks * 1000) AS rate FROM f")
def fp_rate(spark, d):
    return studies.false_positive_rate(_deltas(spark, d), 1000)


_REG = "reg AS (SELECT n_nationkey AS scenario_id, n_regionkey AS category, CASE n_nationkey % 3 WHEN 0 THEN 'static-detectable' WHEN 1 THEN 'agent-judgable' ELSE 'out-of-artifact' END AS tier FROM nation WHERE n_nationkey < 20)"


def _registry(spark, d):
    k = F.col("n_nationkey") % 3
    tier = F.when(k == 0, "static-detectable").when(k == 1, "agent-judgable").otherwise("out-of-artifact")
    return table(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("scenario_id"), F.col("n_regionkey").alias("category"), tier.alias("tier"))


@R.query(f"WITH {_REG} SELECT c_custkey, c_nationkey AS scenario_id FROM customer WHERE c_nationkey NOT IN (SELECT scenario_id FROM reg)")
def unregistered_fixture(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("scenario_id"))
    return integrity.unregistered(c, _registry(spark, d)).select("c_custkey", "scenario_id")


@R.query(f"WITH {_REG} SELECT c_custkey, c_nationkey AS scenario_id FROM customer WHERE c_nationkey IN (SELECT scenario_id FROM reg WHERE tier = 'out-of-artifact')")
def out_of_artifact_cases(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("scenario_id"))
    return integrity.out_of_artifact(c, _registry(spark, d)).select("c_custkey", "scenario_id")


@R.query(f"WITH {_REG}, r AS (SELECT category, sha256(string_agg(scenario_id || ':' || tier, '|' ORDER BY scenario_id || ':' || tier)) AS \"lock\" FROM reg GROUP BY 1) SELECT category, \"lock\" FROM r")
def registry_locks(spark, d):
    return integrity.tier_locks(_registry(spark, d).withColumn("scenario_id", F.col("scenario_id").cast("string")))


@R.query(
    "WITH a AS (SELECT n_nationkey AS scenario_id, 's' || s_suppkey % 4 AS check_id FROM nation JOIN supplier ON s_nationkey = n_nationkey), b AS (SELECT s_nationkey AS scenario_id, 's' || s_suppkey % 5 AS check_id FROM supplier) "
    "SELECT DISTINCT scenario_id, check_id, 'registry-only' AS side FROM a ANTI JOIN b USING (scenario_id, check_id) UNION ALL SELECT DISTINCT scenario_id, check_id, 'claim-only' AS side FROM b ANTI JOIN a USING (scenario_id, check_id)"
)
def signal_symmetry(spark, d):
    s = table(spark, d, "supplier")
    reg = s.groupBy(F.col("s_nationkey").alias("scenario_id")).agg(F.collect_set(F.concat(F.lit("s"), F.col("s_suppkey") % 4)).alias("signal_checks"))
    claims = s.groupBy(F.concat(F.lit("s"), F.col("s_suppkey") % 5).alias("check_id")).agg(F.collect_set("s_nationkey").alias("registry_ids"))
    return integrity.signal_asymmetry(reg, claims)


@R.query("SELECT event_id, CASE WHEN try_cast(props->>'$.k' AS INTEGER) > 90 THEN 'high' END AS flag, json_keys(props) AS keys FROM events")
def config_walk(spark, d):
    """Top-level keys and one flagged value of JSON configuration."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select("event_id", F.when(k > 90, "high").alias("flag"), F.json_object_keys("props").alias("keys"))


@R.query("SELECT nation_id, table_ix, n AS rows FROM (SELECT n_nationkey AS nation_id, unnest([0, 1]) AS table_ix, unnest([3, 2]) AS n FROM nation)")
def markdown_tables(spark, d):
    """Two tables in each of the generated texts, parted by prose."""
    text = F.concat(F.lit("Intro\n| a | b |\n|---|---|\n| "), F.col("n_name"), F.lit(" | 1 |\n| x | 2 |\nProse\n| c |\n| - |\n| "), F.col("n_name"), F.lit(" |\n"))
    rows = markdown.pipe_tables(table(spark, d, "nation").select(F.col("n_nationkey").alias("doc"), text.alias("text")))
    return rows.groupBy(F.col("doc").alias("nation_id"), F.col("table_ix").cast("int").alias("table_ix")).agg(F.count(F.lit(1)).cast("int").alias("rows"))
