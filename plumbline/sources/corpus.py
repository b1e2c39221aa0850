"""Labelled corpora: the manifest that says which package is expected to fire which check, the scenario registry, and the packages."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.packages import read_packages

CHECKS = "category string, corpus_check string, detector_check string, covers string, registry_ids array<string>, tier string, reason string"
CASES = "category string, case_id string, corpus_check string, vulnerable boolean, pkg_id string"
CATEGORIES = "category string, name string, f1_scope string, status string, tier_lock_hash string, registry_tier_lock string"
SCENARIOS = "scenario_id string, category string, title string, tier string, reason string, artifact_signal string, signal_checks array<string>"
LABELS = {"vulnerable": True, "clean": False}


@dataclass
class Corpus:
    """A corpus manifest as tables; least is the fewest cases of a category with checks."""

    checks: DataFrame
    cases: DataFrame
    categories: DataFrame
    least: int


def _text(value: object) -> str | None:
    return None if value is None else str(value)


def parse_corpus(spark: SparkSession, text: str) -> Corpus:
    """The tables of a corpus manifest (YAML, one file by hand, so read on the driver).

    A case's pkg_id is the folder of its path below the folder of its category, as
    `category/folder`. A label other than vulnerable and clean is an error.
    """
    import yaml

    data = yaml.safe_load(text) or {}
    checks, cases, categories = [], [], []
    for category, entry in (data.get("categories") or {}).items():
        entry = entry or {}
        categories.append((category, *(_text(entry.get(k)) for k in ("name", "f1_scope", "status", "tier_lock_hash", "registry_tier_lock"))))
        for s in entry.get("detectable_scenarios") or []:
            checks.append((category, str(s["id"]), _text(s.get("detector_check")), s.get("covers", "full"), [str(x) for x in s.get("registry_ids") or []], str(s["tier"]), _text(s.get("reason"))))
        for c in entry.get("cases") or []:
            if c["label"] not in LABELS:
                raise ValueError(f"{c['id']}: the label is {c['label']!r}")
            folder = str(c["path"]).split(f"{category}/", 1)[-1].split("/", 1)[0]
            cases.append((category, str(c["id"]), str(c["scenario_id"]), LABELS[c["label"]], f"{category}/{folder}"))
    frame = spark.createDataFrame
    return Corpus(frame(checks, CHECKS), frame(cases, CASES), frame(categories, CATEGORIES), int(data.get("min_floor", 6)))


def read_corpus(spark: SparkSession, path: str) -> Corpus:
    return parse_corpus(spark, spark.read.text(path, wholetext=True).first()[0])


def parse_registry(spark: SparkSession, text: str) -> DataFrame:
    """The scenarios of a registry (YAML, one file by hand): what tier each is of, and which checks read its signal."""
    import yaml

    rows = []
    for s in (yaml.safe_load(text) or {}).get("scenarios") or []:
        rows.append((str(s["id"]), str(s["category"]), _text(s.get("title")), str(s["tier"]), _text(s.get("reason")), _text(s.get("artifact_signal")), [str(x) for x in s.get("artifact_signal_checks") or []]))
    return spark.createDataFrame(rows, SCENARIOS)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return parse_registry(spark, spark.read.text(path, wholetext=True).first()[0])


def read_cases(spark: SparkSession, root: str, categories: list[str], slices: int = 8) -> DataFrame:
    """Entries of all packages of a corpus, root / category / package, with pkg_id as `category/package`."""
    each = [read_packages(spark, f"{root}/{c}", slices).withColumn("pkg_id", F.concat(F.lit(f"{c}/"), "pkg_id")) for c in categories]
    return reduce(DataFrame.unionByName, each)
