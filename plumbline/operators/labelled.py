"""Scoring of an audit against a labelled corpus: verdict by case, figures by check, one row for each category, and what does not fit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.scoring import GATE, PER_CHECK, confusion, metrics
from plumbline.sources.corpus import Corpus

SCENARIO_LEVEL, PROXY = "full", "artifact-signal-only"


def misfits(corpus: Corpus, findings: DataFrame) -> DataFrame:
    """Why a corpus cannot be scored: category, kind, name. With any row its figures rest on cases that it does not have.

    Kinds: unlabelled-check (a case of a check that its category does not label), no-detector
    (a check that names none, or one that the audit did not run), covers (a mode that no figure
    has), not-audited (a case whose package has no finding).
    """
    known = corpus.checks.select("category", "corpus_check")
    ran, seen = findings.select(F.col("check_id").alias("detector_check")).distinct(), findings.select("pkg_id").distinct()
    out = lambda rows, kind, name: rows.select("category", F.lit(kind).alias("kind"), F.col(name).alias("name"))
    return (
        out(corpus.cases.join(known, ["category", "corpus_check"], "left_anti"), "unlabelled-check", "case_id")
        .unionByName(out(corpus.checks.join(ran, "detector_check", "left_anti"), "no-detector", "corpus_check"))
        .unionByName(out(corpus.checks.where(~F.col("covers").isin(SCENARIO_LEVEL, PROXY)), "covers", "corpus_check"))
        .unionByName(out(corpus.cases.join(seen, "pkg_id", "left_anti"), "not-audited", "case_id"))
    )


def verdicts(corpus: Corpus, findings: DataFrame) -> DataFrame:
    """Each case with the verdict of the check it is labelled for: category, corpus_check, covers, case_id, pkg_id, expected, predicted, evidence."""
    bound = corpus.cases.join(F.broadcast(corpus.checks.drop("tier", "reason")), ["category", "corpus_check"])  # a hand-written table
    found = findings.select("pkg_id", F.col("check_id").alias("detector_check"), "detected", "evidence")
    out = found.join(bound, ["pkg_id", "detector_check"])
    return out.select("category", "corpus_check", "detector_check", "covers", "case_id", "pkg_id", F.col("vulnerable").alias("expected"), F.col("detected").alias("predicted"), "evidence")


def by_check(judged: DataFrame) -> DataFrame:
    """Figures of each labelled check, and whether it discriminates: no error, and both verdicts seen."""
    out = metrics(judged.groupBy("category", "corpus_check", "detector_check", "covers").agg(*confusion(), F.count_distinct("predicted").alias("_seen")))
    return out.withColumn("discriminates", (F.col("fp") == 0) & (F.col("fn") == 0) & (F.col("_seen") == 2)).drop("_seen")


def leakage(corpus: Corpus, findings: DataFrame) -> DataFrame:
    """Every check of a category that fires on one of its clean cases, labelled for it or not: category, case_id, check_id, evidence."""
    clean = corpus.cases.where("NOT vulnerable").select("category", "case_id", "pkg_id")
    fired = findings.where("detected").withColumn("category", F.left("check_id", F.lit(5)))
    return fired.join(clean, ["pkg_id", "category"]).select("category", "case_id", "check_id", "evidence")


def by_category(corpus: Corpus, findings: DataFrame) -> DataFrame:
    """One row for each category of the corpus; no figure is ever taken over categories.

    checks, cases, vulnerable, clean, floor (cases that so many checks ask for) and
    meets_floor; tp, fp, fn, tn, precision, recall and f1 of the checks that decide scenarios,
    proxy_f1 of those that read signals alone; status by the first of them: pass, fail, or
    declared-and-uncovered without such a check; leaks; and f1_state: published,
    pending-detector (a check that names none) or empty-tier.
    """
    judged = verdicts(corpus, findings)
    of = lambda mode: metrics(judged.where(F.col("covers") == mode).groupBy("category").agg(*confusion()))
    size = corpus.cases.groupBy("category").agg(F.count(F.lit(1)).alias("cases"), F.count_if("vulnerable").alias("vulnerable"), F.count_if(~F.col("vulnerable")).alias("clean"))
    checks = corpus.checks.groupBy("category").agg(F.count(F.lit(1)).alias("checks"), F.count_if(F.col("detector_check").isNull()).alias("unbound"))
    leaks = leakage(corpus, findings).groupBy("category").agg(F.count(F.lit(1)).alias("leaks"))
    out = corpus.categories.select("category", "name", "f1_scope")
    for part in (checks, size, of(SCENARIO_LEVEL), of(PROXY).select("category", F.col("f1").alias("proxy_f1")), leaks):
        out = out.join(part, "category", "left")
    out = out.na.fill(0, ["checks", "cases", "vulnerable", "clean", "leaks", "unbound"])
    floor = F.when(F.col("checks") == 0, 0).otherwise(F.greatest(F.lit(corpus.least), F.col("checks") * PER_CHECK))
    status = F.when(F.col("f1").isNull(), "declared-and-uncovered").when(F.col("f1") >= GATE, "pass").otherwise("fail")
    state = F.when(F.col("checks") == 0, "empty-tier").when(F.col("unbound") > 0, "pending-detector").otherwise("published")
    figures = ["tp", "fp", "fn", "tn", "precision", "recall", "f1", "proxy_f1"]
    return out.select(
        "category", "name", "f1_scope", "checks", "cases", "vulnerable", "clean", floor.alias("floor"), (F.col("cases") >= floor).alias("meets_floor"), *figures, status.alias("status"), "leaks", state.alias("f1_state")
    )


def on_disk(corpus: Corpus, entries: DataFrame) -> DataFrame:
    """Packages that are there and those that are labelled, by category: category, packages, labelled, delta."""
    there = entries.select("pkg_id").distinct().groupBy(F.substring_index("pkg_id", "/", 1).alias("category")).agg(F.count(F.lit(1)).alias("packages"))
    told = corpus.cases.groupBy("category").agg(F.count_distinct("pkg_id").alias("labelled"))
    return there.join(told, "category", "full_outer").na.fill(0, ["packages", "labelled"]).withColumn("delta", F.col("packages") - F.col("labelled"))


def executions(findings: DataFrame) -> DataFrame:
    """How many checks ran, fired and left something undecided, by category, and over all (category null)."""
    rows = findings.withColumn("category", F.left("check_id", F.lit(5)))
    return rows.rollup("category").agg(F.count(F.lit(1)).alias("runs"), F.count_if("detected").alias("fired"), F.count("note").alias("noted"))


def scenarios(claims: DataFrame, registry: DataFrame, findings: DataFrame) -> DataFrame:
    """Each scenario of the registry for each package, by the checks that decide it: pkg_id, scenario_id, tier, detected, decided_by.

    claims has check_id, covers and registry_ids. Only checks that cover a scenario in full
    decide it, any one of them is enough, and the first to fire by id is named; a scenario
    without such a check is not decided (detected is null).
    """
    deciding = claims.where("covers = 'full'").select("check_id", F.explode("registry_ids").alias("scenario_id"))
    fired = findings.select("pkg_id", "check_id", "detected").join(F.broadcast(deciding), "check_id")
    decided = fired.groupBy("pkg_id", "scenario_id").agg(F.bool_or("detected").alias("detected"), F.min(F.when(F.col("detected"), F.col("check_id"))).alias("decided_by"))
    grid = findings.select("pkg_id").distinct().crossJoin(F.broadcast(registry.select("scenario_id", "tier")))  # the registry is written by hand
    return grid.join(decided, ["pkg_id", "scenario_id"], "left").select("pkg_id", "scenario_id", "tier", "detected", "decided_by")
