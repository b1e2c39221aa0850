"""The audit of packages: every check, and the findings with what each claims to cover."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import checks, code_checks, config_checks, hazard_checks, payload_checks
from plumbline.sources.packages import SURFACE, surface

# --- fixed values ---
CATEGORIES = [f"AST{i:02}" for i in range(1, 11)]
MODES = ["full", "artifact-signal-only", "category-precondition"]
SURFACE_SCOPED = ["AST01"]
UNREAD = ["none", "SKILL.md (no parseable frontmatter)"]
# --- end of fixed values ---


def run_all(packages: DataFrame, files: DataFrame, entries: DataFrame) -> DataFrame:
    """Findings of every check for packages: pkg_id, check_id, detected, evidence, covers, note.

    packages is what manifests.declared makes of manifests, with the column manifest; files is
    what sources.packages.scan makes of entries. There is a row for each package and each of
    the checks in checks.COVERS. Evidence is null where nothing was detected; note says what
    a check did not decide (files that cannot be parsed, bounds that were met, hosts that
    cannot be told), so a row without evidence is clean only without such a note.
    """
    found = [
        checks.declared_findings(packages), checks.text_findings(packages, files), checks.hash_findings(packages, surface(files)),
        checks.bytecode_findings(packages, entries), code_checks.code_findings(packages, files), code_checks.egress_findings(packages, files),
        config_checks.config_findings(packages, files), payload_checks.payload_findings(packages, files), hazard_checks.hazard_findings(packages, entries),
    ]
    covers = F.coalesce(*(F.when(F.col("check_id") == c, F.lit(v)) for c, v in checks.COVERS.items()))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
    return out.select("pkg_id", "check_id", "detected", "evidence", covers.alias("covers"), "note")


def declaration_state(read: DataFrame, packages: DataFrame) -> DataFrame:
    """What packages declare: pkg_id and declaration (source, manifest_found, declares_permissions, declares_content_hash).

    read is what manifests.read_manifests gives, packages what manifests.declared makes of it.
    """
    both = packages.select("pkg_id", "has_perms", "content_hash").join(read.select("pkg_id", "source"), "pkg_id")
    return both.select(
        "pkg_id",
        F.struct(
            "source", (~F.col("source").isin(UNREAD)).alias("manifest_found"), F.col("has_perms").alias("declares_permissions"), F.col("content_hash").isNotNull().alias("declares_content_hash")
        ).alias("declaration"),
    )


def roll_up(findings: DataFrame) -> DataFrame:
    """categories and totals of findings (of run_all), a row for each package.

    Every category is there, those without a check too, with its findings by check. Totals count
    checks and detections, these also by what the check covers, every mode of it named. A
    package has as many findings as there are checks, so its row is bounded.
    """
    one = F.struct("check_id", "covers", "detected", "evidence", "note")
    by_category = findings.groupBy("pkg_id", F.left("check_id", F.lit(5)).alias("category")).agg(F.array_sort(F.collect_list(one)).alias("findings"))
    grid = findings.select("pkg_id").distinct().select("pkg_id", F.explode(F.array(*map(F.lit, CATEGORIES))).alias("category"))
    ran = F.col("findings").isNotNull()
    scope = F.when(ran, F.when(F.col("category").isin(SURFACE_SCOPED), "declared-surface").otherwise("all-files"))
    whole = grid.join(by_category, ["pkg_id", "category"], "left").select(
        "pkg_id", F.struct("category", F.when(ran, "ran").otherwise("no-static-detectors").alias("status"), scope.alias("scope"), F.coalesce("findings", F.array().cast("array<struct<check_id:string,covers:string,detected:boolean,evidence:string,note:string>>")).alias("findings")).alias("c")
    )
    categories = whole.groupBy("pkg_id").agg(F.array_sort(F.collect_list("c")).alias("categories"), F.count_if(F.col("c.status") != "ran").alias("idle"))
    modes = F.create_map(*(x for m in MODES for x in (F.lit(m), F.count_if(F.col("detected") & (F.col("covers") == m)))), F.lit("undeclared"), F.count_if(F.col("detected") & ~F.coalesce(F.col("covers").isin(MODES), F.lit(False))))
    totals = findings.groupBy("pkg_id").agg(F.count(F.lit(1)).alias("checks_run"), F.count_if("detected").alias("detected"), modes.alias("detected_by_coverage"))
    return categories.join(totals, "pkg_id").select(
        "pkg_id", "categories", F.struct(F.lit(len(CATEGORIES)).alias("categories"), F.col("idle").alias("categories_without_detectors"), "checks_run", "detected", "detected_by_coverage").alias("totals")
    )


def payload(packages: DataFrame, files: DataFrame, findings: DataFrame, read: DataFrame) -> DataFrame:
    """The audit of each package as one JSON text: pkg_id, payload.

    manifest_source, declaration, the names of scanned and of surface files, skipped files
    with reasons, categories with findings, totals. packages, files and findings are what
    run_all takes and gives. A package without files or findings has empty lists.
    """
    names = files.groupBy("pkg_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.col("path")))).alias("scan_files"),
        F.array_sort(F.collect_list(F.when(F.col("text").isNotNull() & F.col("path").rlike(SURFACE), F.col("path")))).alias("surface_files"),
        F.array_sort(F.collect_list(F.when(F.col("skip_reason").isNotNull(), F.struct("path", F.col("skip_reason").alias("reason"))))).alias("skipped_files"),
    )
    out = packages.select("pkg_id").join(declaration_state(read, packages), "pkg_id").join(names, "pkg_id", "left").join(roll_up(findings), "pkg_id", "left")
    fields = [F.col("pkg_id").alias("path"), F.col("declaration.source").alias("manifest_source"), "declaration", "scan_files", "surface_files", "skipped_files", "categories", "totals"]
    return out.select("pkg_id", F.to_json(F.struct(F.lit("audit").alias("command"), *fields)).alias("payload"))


def stale(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Packages whose stored payload(pkg_id, payload) is not the fresh one: pkg_id, state (changed, new, gone)."""
    digest = lambda df, name: df.select("pkg_id", F.sha2("payload", 256).alias(name))
    both = digest(stored, "old").join(digest(fresh, "now"), "pkg_id", "full_outer")
    state = F.when(F.col("old").isNull(), "new").when(F.col("now").isNull(), "gone").otherwise("changed")
    return both.where(~F.col("old").eqNullSafe(F.col("now"))).select("pkg_id", state.alias("state"))
