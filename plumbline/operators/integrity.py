"""Referential rules between dimensions, as anti-joins; each returns its violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import digests


def unregistered(cases: DataFrame, registry: DataFrame, key: str = "scenario_id") -> DataFrame:
    """Labelled cases of scenarios that the registry does not have."""
    return cases.join(registry.select(key).distinct(), key, "left_anti")


def out_of_artifact(cases: DataFrame, registry: DataFrame) -> DataFrame:
    """Cases of scenarios that no artifact can decide."""
    return cases.join(registry.where("tier = 'out-of-artifact'").select("scenario_id"), "scenario_id", "left_semi")


def signal_asymmetry(registry: DataFrame, claims: DataFrame) -> DataFrame:
    """Signals that the registry names and no check claims, and the other way round."""
    a = registry.select("scenario_id", F.explode("signal_checks").alias("check_id"))
    b = claims.select("check_id", F.explode("registry_ids").alias("scenario_id")).select("scenario_id", "check_id")
    x = a.join(b, ["scenario_id", "check_id"], "left_anti").withColumn("side", F.lit("registry-only"))
    y = b.join(a, ["scenario_id", "check_id"], "left_anti").withColumn("side", F.lit("claim-only"))
    return x.unionByName(y)


def tier_locks(registry: DataFrame) -> DataFrame:
    """The lock of each category: a digest of its scenario tiers."""
    return registry.groupBy("category").agg(digests.lock(F.col("scenario_id"), F.col("tier")).alias("lock"))


def broken_locks(registry: DataFrame, recorded: DataFrame) -> DataFrame:
    """Categories whose recorded lock is missing or differs."""
    out = tier_locks(registry).join(recorded.withColumnRenamed("lock", "recorded"), "category", "left")
    return out.where("recorded IS NULL OR recorded <> lock")


def below_floor(cases: DataFrame, checks: DataFrame) -> DataFrame:
    """Categories with fewer labelled cases than their checks ask for."""
    from plumbline.operators.scoring import floor_of

    n = cases.groupBy("category").agg(F.count(F.lit(1)).alias("cases"))
    c = checks.groupBy("category").agg(F.count(F.lit(1)).alias("checks"))
    return c.join(n, "category", "left").na.fill(0, ["cases"]).withColumn("floor", floor_of(F.col("checks"))).where("cases < floor")


#: What a check can claim over a scenario.
COVERS = ["full", "artifact-signal-only", "category-precondition"]


def claim_faults(claims: DataFrame) -> DataFrame:
    """What is wrong with claims(check_id, covers, registry_ids, reason, derivation): check_id, fault, a row for each.

    A mode that is none of COVERS hides the other faults of a claim. Every claim gives a
    reason; a category-precondition links no scenario and says what it derives from; the
    other modes link one at least.
    """
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    none = F.coalesce(F.size("registry_ids"), F.lit(0)) == 0
    derived = F.col("covers") == "category-precondition"
    odd = ~F.coalesce(F.col("covers").isin(COVERS), F.lit(False))
    faults = F.when(odd, F.array(F.lit("no such mode"))).when(F.col("registry_ids").isNull(), F.array(F.lit("no list of scenarios"))).otherwise(
        F.array_compact(
            F.array(
                F.when(blank("reason"), "no reason"), F.when(derived & ~none, "a precondition that links a scenario"), F.when(derived & blank("derivation"), "no derivation"),
                F.when(~derived & none, "no scenario"),
            )
        )
    )
    return claims.select("check_id", F.explode(faults).alias("fault"))


def signal_faults(registry: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims that the registry does not bear out: check_id, scenario_id, fault.

    A link has to lead to a scenario that is there; a full claim to one that a static check
    can decide, and a signal claim to one that names a signal.
    """
    links = claims.select("check_id", "covers", F.explode("registry_ids").alias("scenario_id"))
    out = links.join(F.broadcast(registry.select("scenario_id", "tier", "artifact_signal")), "scenario_id", "left")  # the registry is written by hand
    fault = (
        F.when(F.col("tier").isNull(), "no such scenario").when((F.col("covers") == "full") & (F.col("tier") != "static-detectable"), "full, of a scenario that no static check decides")
        .when((F.col("covers") == "artifact-signal-only") & F.col("artifact_signal").isNull(), "a signal that the scenario does not name")
    )
    return out.select("check_id", "scenario_id", fault.alias("fault")).where("fault IS NOT NULL")
