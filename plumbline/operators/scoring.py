"""Detector scoring on labelled cases: confusion, precision, recall, F1, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GATE = 0.80
#: Fewest labelled cases of a category, and cases asked for each check.
FLOOR, PER_CHECK = 6, 2


def confusion() -> list[Column]:
    """Aggregates over expected and predicted (boolean)."""
    e, p = F.col("expected"), F.col("predicted")
    return [
        F.count_if(e & p).alias("tp"),
        F.count_if(~e & p).alias("fp"),
        F.count_if(e & ~p).alias("fn"),
        F.count_if(~e & ~p).alias("tn"),
    ]


def ratio(a: Column, b: Column) -> Column:
    """0.0 for a zero denominator."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def metrics(df: DataFrame) -> DataFrame:
    """precision, recall and f1 beside tp, fp, fn, tn; null where nothing was scored."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    scored = (tp + fp + fn + F.col("tn")) > 0
    return df.withColumns(
        {
            "precision": F.when(scored, ratio(tp, tp + fp)),
            "recall": F.when(scored, ratio(tp, tp + fn)),
            "f1": F.when(scored, ratio(2 * tp, 2 * tp + fp + fn)),
        }
    )


def score(cases: DataFrame, *by: str) -> DataFrame:
    """Confusion and metrics of cases(expected, predicted) by the given columns."""
    return metrics(cases.groupBy(*by).agg(*confusion()))


def score_sets(cases: DataFrame, *levels: tuple[str, ...]) -> DataFrame:
    """Micro metrics at several levels at once: sums first, one ratio after."""
    cols = sorted({c for lev in levels for c in lev}, key=lambda c: next(i for lev in levels for i, x in enumerate(lev) if x == c))
    grouped = cases.groupingSets([[F.col(c) for c in lev] for lev in levels], *(F.col(c) for c in cols))
    return metrics(grouped.agg(*confusion()))


def gate(df: DataFrame, at: float = GATE) -> DataFrame:
    """pass, fail, or declared-and-uncovered where nothing was scored."""
    return df.withColumn("status", F.when(F.col("f1").isNull(), "declared-and-uncovered").when(F.col("f1") >= at, "pass").otherwise("fail"))


def per_check(cases: DataFrame) -> DataFrame:
    """Metrics of each check and whether it discriminates: no error and both verdicts seen."""
    out = metrics(cases.groupBy("check_id").agg(*confusion(), F.countDistinct("predicted").alias("verdicts")))
    return out.withColumn("discriminates", (F.col("fp") == 0) & (F.col("fn") == 0) & (F.col("verdicts") == 2)).drop("verdicts")


def set_f1(expected: Column, static: Column, detected: Column) -> list[Column]:
    """tp, fp, fn of one case by sets: expected is cut to the static tier, detected is not."""
    want = F.array_intersect(expected, static)
    return [
        F.size(F.array_intersect(want, detected)).alias("tp"),
        F.size(F.array_except(detected, want)).alias("fp"),
        F.size(F.array_except(want, detected)).alias("fn"),
    ]


def floor_of(checks: Column) -> Column:
    """Cases that a category with so many checks must have."""
    return F.when(checks == 0, 0).otherwise(F.greatest(F.lit(FLOOR), checks * PER_CHECK))


def scope_label(modes: Column) -> Column:
    """Aggregate: one label for the coverage modes behind a figure."""
    found = F.collect_set(modes)
    return F.when(F.size(found) == 0, "none").when(F.size(found) == 1, F.element_at(found, 1)).otherwise("mixed-proxy")


def leakage(cases: DataFrame, *by: str) -> DataFrame:
    """Clean cases that fired, and the class balance."""
    return cases.groupBy(*by).agg(
        F.count_if(~F.col("expected") & F.col("predicted")).alias("leaked"),
        F.count_if(F.col("expected")).alias("vulnerable"),
        F.count_if(~F.col("expected")).alias("clean"),
    )
