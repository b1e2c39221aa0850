"""From rule hits to findings: first match, waivers, coverage ledger, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as t

# --- fixed values: how a scenario that no static check decides is reported, by tier ---
UNDECIDED = {
    "agent-judgable": ("open", "declared agent-judgable: decidable from this package, but not by a static check"),
    "out-of-artifact": ("notApplicable", "declared out-of-artifact: the defining condition is not in this package at any depth"),
}
# --- end of fixed values ---


def rule_hits(files: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """One row for each file and rule with a match: pkg_id, path, rule_ix, rule, offset, line, excerpt.

    The rules are unrolled into one projection, so a file is scanned where it lies and only
    hits leave it; no rules-by-files join. Where a match lies is looked for in hits alone.
    """

    def one(i: int, name: str, pattern: str) -> Column:
        offset = F.regexp_instr("text", F.lit(pattern))
        line = F.regexp_count(F.left("text", offset - 1), F.lit("\n")) + 1
        found = F.struct(
            F.lit(i).alias("rule_ix"), F.lit(name).alias("rule"), offset.alias("offset"), line.alias("line"), F.regexp_extract("text", pattern, 0).alias("excerpt")
        )
        return F.when(F.col("text").rlike(pattern), found)

    hits = F.array_compact(F.array(*(one(i, name, p) for i, (name, p) in enumerate(rules))))
    return files.select("pkg_id", "path", F.explode(hits).alias("r")).select("pkg_id", "path", "r.*")


def first_match(hits: DataFrame, *by: str) -> DataFrame:
    """The first hit in path, rule and offset order for each package (and check)."""
    return hits.groupBy(*by).agg(F.min(F.struct("path", "rule_ix", "offset", "rule", "excerpt")).alias("x")).select(*by, "x.*")


def apply_waivers(findings: DataFrame, waivers: DataFrame) -> DataFrame:
    """Mark findings with the first waiver of equal pkg_id and scenario whose fragment the evidence holds.

    waivers has skill, scenario, evidence_contains, reason and ordinal. They are listed by
    skill and scenario first, so that every finding is one row before and after, repeated
    ones too.
    """
    one = F.struct("ordinal", "evidence_contains", "reason")
    listed = waivers.groupBy(F.col("skill").alias("_skill"), F.col("scenario").alias("_scenario")).agg(F.array_sort(F.collect_list(one)).alias("_waivers"))
    out = findings.join(listed, (F.col("pkg_id") == F.col("_skill")) & (F.col("scenario") == F.col("_scenario")), "left")
    first = F.get(F.filter("_waivers", lambda w: F.col("evidence").contains(w["evidence_contains"])), F.lit(0))
    out = out.withColumn("_first", first)
    return out.select(*findings.columns, F.col("_first").isNotNull().alias("waived"), F.col("_first.reason").alias("waiver_reason"))


def stale_waivers(findings: DataFrame, waivers: DataFrame) -> DataFrame:
    """Waivers whose skill and scenario no finding has that a waiver of the two matches, evidence included."""
    f = findings.select("pkg_id", F.col("scenario").alias("_scenario"), "evidence")
    match = (F.col("pkg_id") == F.col("skill")) & (F.col("_scenario") == F.col("scenario")) & F.col("evidence").contains(F.col("evidence_contains"))
    used = f.join(waivers, match).select("skill", "scenario").distinct()
    return waivers.join(used, ["skill", "scenario"], "left_anti")


def ledger(findings: DataFrame, checks: DataFrame) -> DataFrame:
    """Every check of every package: fired, clear, or not run, with its claim."""
    roster = findings.select("pkg_id").distinct().crossJoin(F.broadcast(checks))
    fired = findings.groupBy("pkg_id", "check_id").agg(F.max("detected").alias("detected"), F.min("evidence").alias("evidence"))
    out = roster.join(fired, ["pkg_id", "check_id"], "left")
    status = F.when(F.col("detected").isNull(), "not-run").when(F.col("detected"), "fired").otherwise("clear")
    return out.withColumn("status", status)


def detected_by_coverage(findings: DataFrame, modes: DataFrame) -> DataFrame:
    """Count of detections by coverage mode, zero where none, with a bucket for undeclared."""
    counted = findings.where("detected").groupBy(F.coalesce("covers", F.lit("undeclared")).alias("covers")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(modes).join(counted, "covers", "left").select("covers", F.coalesce("n", F.lit(0)).alias("detected"))


def scenario_results(findings: DataFrame, bridge: DataFrame) -> DataFrame:
    """Re-key check findings onto the scenarios they decide in full; any firing check decides."""
    hit = findings.join(F.broadcast(bridge.where("covers = 'full'").select("check_id", "scenario_id", "ordinal")), "check_id")
    return hit.groupBy("pkg_id", "scenario_id").agg(F.max("detected").alias("detected"), F.min(F.when(F.col("detected"), F.struct("ordinal", "check_id")))["check_id"].alias("decided_by"))


def rollup_counts(df: DataFrame, *by: str) -> DataFrame:
    """Counts by the given columns with a TOTAL row for each level; a null key stays null."""
    out = df.rollup(*by).agg(F.count(F.lit(1)).alias("n"), *(F.grouping(c).alias(f"_all_{c}") for c in by))
    return out.select(*(F.when(F.col(f"_all_{c}") == 1, "TOTAL").otherwise(F.col(c)).alias(c) for c in by), "n")


def sarif_results(findings: DataFrame) -> DataFrame:
    """Rows of a SARIF run for checks that ran: a fail where they fired (an error if they decide in full), else a pass.

    A fired check has a location if its evidence begins with a file name and, maybe, a line.
    """
    detected, rule = F.col("detected"), F.col("check_id")
    level = F.when(~detected, "none").when(F.col("covers") == "full", "error").otherwise("warning")
    fired = F.coalesce(F.nullif(t.sarif_text(F.col("evidence")), F.lit("")), F.concat(rule, F.lit(" detected")))
    place = r"^([\w./-]+\.[A-Za-z0-9]+)(?::(\d+))?[:\s]"
    uri = F.when(detected, F.nullif(F.regexp_extract("evidence", place, 1), F.lit("")))
    line = F.when(detected, F.regexp_extract("evidence", place, 2).try_cast("int"))
    return findings.select(
        "pkg_id", rule.alias("rule_id"), F.when(detected, "fail").otherwise("pass").alias("kind"), level.alias("level"),
        F.when(detected, fired).otherwise(F.concat(rule, F.lit(": ran and cleared"))).alias("message"), t.uri_path(uri).alias("uri"), line.alias("start_line"),
    )


def sarif_undecided(packages: DataFrame, declared: DataFrame) -> DataFrame:
    """Rows of a SARIF run for declared(scenario_id, tier) that no static check decides, for each of packages(pkg_id)."""
    tier, rule = F.col("tier"), F.col("scenario_id")
    known = declared.where(tier.isin(*UNDECIDED))
    kind, why = (F.coalesce(*(F.when(tier == k, F.lit(v[i])) for k, v in UNDECIDED.items())) for i in range(2))
    return packages.select("pkg_id").distinct().crossJoin(known).select(
        "pkg_id", F.concat(rule, F.lit("-undecided")).alias("rule_id"), kind.alias("kind"), F.lit("none").alias("level"),
        F.concat(rule, F.lit(": "), why, F.lit(". This run makes no claim about it.")).alias("message"),
        F.lit(None).cast("string").alias("uri"), F.lit(None).cast("int").alias("start_line"),
    )


def count_if(cond: Column) -> Column:
    return F.count_if(cond).cast("long")
