"""Quality rules with risk-controlled cutoffs, in DataFrame operations only.

Each rule gives a document a badness, scaled so that 1 is as bad by one rule as by another.
All rules are tightened together, along a fixed grid from lenient to strict: a step is
accepted while an exact binomial test on the labelled good documents of a stratum shows that
the rules together reject at most a share RISK of them (fixed-sequence testing: one level
serves the whole grid); levels are split over the strata (Bonferroni). So with confidence
1 - DELTA no stratum loses more than RISK of its good documents to the rules. A stratum needs
as many good labels, none of them beyond a cutoff, as make (1 - RISK) to that power fall
to DELTA over the number of strata: 217 for four strata.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.llm.common import WHITE, broadcast_if_small, let, stage

#: Largest share of good documents that may be lost in a stratum, and the chance of failing that anywhere.
RISK, DELTA = 0.02, 0.05
#: Cutoffs of every rule, from lenient to strict.
GRID = [4.0 * 0.85**j for j in range(48)]
REPEAT = 5


def _repeated(words: Column) -> Column:
    """Words inside REPEAT-word windows that occur twice or more in the text."""

    def grams(h: Column) -> Column:
        at = F.transform(F.sequence(F.lit(0), F.size(h) - REPEAT), lambda i: F.xxhash64(*(h[i + j] for j in range(REPEAT))))
        return F.when(F.size(h) >= REPEAT, at).otherwise(F.array().cast("array<bigint>"))

    def places(g: Column) -> Column:
        ordered = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = let(
            ordered,
            lambda s: F.filter(
                F.transform(s, lambda e, i: F.when((e["x"] == F.get(s, i - 1)["x"]) | (e["x"] == F.get(s, i + 1)["x"]), e["i"])), lambda p: p.isNotNull()
            ),
        )
        return F.array_sort(twice)

    def covered(places: Column) -> Column:
        return F.aggregate(
            places,
            F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
            lambda acc, p: F.struct((p + REPEAT).alias("end"), (acc["n"] + p + REPEAT - F.greatest(acc["end"], p)).cast("long").alias("n")),
        )["n"]

    return let(
        let(F.transform(words, lambda w: F.xxhash64(w)), grams),
        lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(places(g))),
    )


def measures(docs: DataFrame) -> DataFrame:
    """The base columns of every document's whole text, with n_lines and the stratum (lang, '' for null)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(
        F.array_remove(F.split(text, WHITE), ""),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeated(w).alias("n_repeat_words")
        ),
    )
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    out = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"),
        of_words.alias("w"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        of_lines.alias("l"),
    )
    out = out.select("doc_id", "stratum", "w.*", "n_symbols", "l.*")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def badness() -> dict[str, Column]:
    """The rules: what grows as a text gets worse; null without words.

    1 is a symbol for each 10 words, 30 % of repeated lines, 20 % of repeated words, and words
    of 10 or of 3 characters on average.
    """

    def ratio(a: Column, b: Column) -> Column:
        return F.try_divide(a.cast("double"), b.cast("double"))

    c = F.col
    return {
        "symbols": ratio(c("n_symbols") * 10, c("n_words")),
        "dup_lines": ratio(c("n_dup_lines") * 10, c("n_lines") * 3),
        "repeats": ratio(c("n_repeat_words") * 5, c("n_words")),
        "long_words": ratio(c("word_chars"), c("n_words") * 10),
        "short_words": ratio(c("n_words") * 3, c("word_chars")),
    }


def worst() -> Column:
    """The badness of a document by the rule that it is worst by; null without words."""
    return F.greatest(*badness().values())


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of n trials, exactly, term by term in logarithms; 1 where k is above the mean."""
    ln_q, ln_odds = math.log1p(-p), math.log(p / (1 - p))
    start = F.struct((n * ln_q).alias("t"), F.exp(n * ln_q).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        t = acc["t"] + F.log((n - i + 1).cast("double") / i) + ln_odds
        return F.struct(t.alias("t"), (acc["sum"] + F.exp(t)).alias("sum"))

    some = F.aggregate(F.sequence(F.lit(1).cast("long"), k), start, step)["sum"]
    return F.when(k > n * p, 1.0).when(k == 0, F.exp(n * ln_q)).otherwise(some)


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, cutoff): the strictest accepted cutoff of all rules together; none, no row."""
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    held = measured.where("NOT base_failed").join(good, "doc_id")
    grid, bad = F.array(*(F.lit(c) for c in GRID)), worst()
    tally = held.groupBy("stratum", F.size(F.filter(grid, lambda c: bad > c)).alias("over")).agg(F.count(F.lit(1)).alias("n"))
    tally = stage(tally, "tally")  # a row for each stratum and grid step at most
    steps = tally.sparkSession.range(len(GRID)).select(F.col("id").cast("int").alias("step"))
    sums = tally.groupBy("stratum").agg(F.sum("n").alias("n"))
    rejected = (
        sums.crossJoin(F.broadcast(steps))  # len(GRID) rows
        .join(tally.withColumnRenamed("n", "m"), "stratum")
        .groupBy("stratum", "n", "step")
        .agg(F.sum(F.when(F.col("over") >= len(GRID) - F.col("step"), F.col("m")).otherwise(0)).alias("k"))
    )
    level = sums.select((F.lit(delta) / F.count(F.lit(1))).alias("level"))
    tested = rejected.crossJoin(F.broadcast(level)).withColumn("passes", binomial_cdf(F.col("k"), F.col("n"), risk) <= F.col("level"))
    in_turn = W.partitionBy("stratum").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    passed = tested.withColumn("all_so_far", F.min("passes").over(in_turn)).where("all_so_far")
    best = passed.groupBy("stratum").agg(F.max("step").alias("step"))
    return best.select("stratum", grid[F.col("step")].alias("cutoff"))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Measure every document and keep those that pass the base rule and, by every rule, the accepted cutoff.

    docs needs doc_id (long), text and lang, labels doc_id and quality (1: good); other
    columns are ignored, whatever their names. Returns one row per row of docs: doc_id,
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.
    A null text counts as empty: no words, base_failed. A null lang is a stratum of its
    own. A document with several labels is good only if all are 1; null ids match no label;
    repeated rows each count. In a stratum without labels, or with too few to prove a cutoff,
    the rules reject nothing. An empty table gives an empty one.
    """
    measured = stage(measures(docs), "measures")
    accepted = stage(cutoffs(measured, labels), "cutoffs")
    out = measured.join(broadcast_if_small(accepted), "stratum", "left")
    bad = F.coalesce(worst() > F.col("cutoff"), F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~bad).alias("kept"))


_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
_BADNESS = [
    "(n_symbols * 10)::DOUBLE / nullif(n_words, 0)",
    "(n_dup_lines * 10)::DOUBLE / nullif(n_lines * 3, 0)",
    "(n_repeat_words * 5)::DOUBLE / nullif(n_words, 0)",
    "word_chars::DOUBLE / nullif(n_words * 10, 0)",
    "(n_words * 3)::DOUBLE / nullif(word_chars, 0)",
]
ORACLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, {_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l,
         row_number() OVER () AS row_id
  FROM documents),
g AS (
  SELECT row_id, i, count(*) OVER (PARTITION BY row_id, gram) AS n
  FROM (SELECT row_id, i, array_to_string(w[i:i + {REPEAT - 1}], ' ') AS gram
        FROM (SELECT row_id, w, unnest(range(1, len(w) - {REPEAT - 2})) AS i FROM d))),
r AS (
  SELECT row_id, sum(least({REPEAT}, coalesce(nxt - i, {REPEAT}))) AS n
  FROM (SELECT row_id, i, lead(i) OVER (PARTITION BY row_id ORDER BY i) AS nxt FROM g WHERE n > 1) GROUP BY row_id),
m AS (
  SELECT d.*, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN r USING (row_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
rules AS (SELECT row_id, doc_id, stratum, base_failed, greatest({", ".join(_BADNESS)}) AS bad FROM b),
grid AS (SELECT step, {GRID!r}[step + 1]::DOUBLE AS cutoff FROM (SELECT unnest(range({len(GRID)})) AS step)),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
k AS (
  SELECT stratum, step, cutoff, count(*) AS n, count(*) FILTER (WHERE bad > cutoff) AS k
  FROM rules JOIN good USING (doc_id), grid WHERE NOT base_failed GROUP BY ALL),
level AS (SELECT {DELTA} / count(DISTINCT stratum) AS level FROM k),
p AS (
  SELECT k.*, CASE WHEN k > n * {RISK!r} THEN 1.0 ELSE list_sum(list_transform(range(k + 1), lambda i:
    exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK!r}) + (n - i) * ln(1 - {RISK!r})))) END <= level AS passes
  FROM k, level),
best AS (
  SELECT stratum, min(cutoff) AS cutoff
  FROM (SELECT *, bool_and(passes) OVER (PARTITION BY stratum ORDER BY step) AS ok FROM p) WHERE ok GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(bad > best.cutoff, false) AS kept
FROM b JOIN (SELECT row_id, bad FROM rules) USING (row_id) LEFT JOIN best USING (stratum)
"""
