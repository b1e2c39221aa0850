"""Paired evaluations: with and without an arm, deltas, assertion buckets, grounded evidence.

results has slug, arm ('with' or 'without'), idx (assertion), passed and evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import fold

# --- fixed values: what grounds evidence, and the assertions that a script decides, tried in this order ---
#: Least lengths of a quoted span and of a verbatim window.
QUOTE, VERBATIM = 12, 24
QUOTED = r"[\"“”'`]{1,3}([^\"“”'`]{12,})[\"“”'`]{1,3}"
CITED = r"([\w./-]+\.\w+):(\d+)"
FORMS = [
    ("file_exists", r"(?:an?\s+)?output file (?:named |called )?[`\"']?([\w./-]+)[`\"']? exists"),
    ("valid_json", r"(?:the )?output file [`\"']?([\w./-]+)[`\"']? (?:is|parses as|contains) valid JSON"),
    ("literal_present", r"the output contains the (?:exact )?(?:string|text|literal) [`\"'](.+?)[`\"']"),
    ("literal_absent", r"the output does not contain the (?:exact )?(?:string|text|literal) [`\"'](.+?)[`\"']"),
    ("line_count", r"(?:the )?output file [`\"']?([\w./-]+)[`\"']? has exactly (\d+) lines?"),
]
# --- end of fixed values ---


def arm_rates(results: DataFrame) -> DataFrame:
    """Pass rate of each slug and arm."""
    return results.groupBy("slug", "arm").agg(F.avg(F.col("passed").cast("double")).alias("pass_rate"), F.count(F.lit(1)).alias("total"))


def pair_arms(rates: DataFrame) -> DataFrame:
    """Both arms of a slug side by side; a missing arm is null."""
    a = rates.where("arm = 'with'").select("slug", F.col("pass_rate").alias("with_rate"))
    b = rates.where("arm = 'without'").select("slug", F.col("pass_rate").alias("without_rate"))
    return a.join(b, "slug", "full_outer")


def paired_delta(pairs: DataFrame, *by: str) -> DataFrame:
    """Means, deviations and the delta of means over slugs that have both arms; how many are left out."""
    both = F.col("with_rate").isNotNull() & F.col("without_rate").isNotNull()

    def over(c: str) -> Column:
        return F.when(both, F.col(c))

    out = pairs.groupBy(*by).agg(
        F.count_if(both).alias("paired"), F.count_if(~both).alias("excluded"), F.avg(over("with_rate")).alias("with_mean"),
        F.avg(over("without_rate")).alias("without_mean"), F.stddev_samp(over("with_rate")).alias("with_sd"), F.stddev_samp(over("without_rate")).alias("without_sd"),
    )
    return out.withColumn("delta", F.col("with_mean") - F.col("without_mean"))


def assertion_buckets(results: DataFrame) -> DataFrame:
    """What each assertion tells: unanimous on both arms, on one, or mixed."""
    w, o = F.col("arm") == "with", F.col("arm") == "without"
    agg = results.groupBy("slug", "idx").agg(
        F.bool_and(F.when(w, F.col("passed"))).alias("w_all"), F.bool_or(F.when(w, F.col("passed"))).alias("w_any"),
        F.bool_and(F.when(o, F.col("passed"))).alias("o_all"), F.bool_or(F.when(o, F.col("passed"))).alias("o_any"),
    )
    c = F.col
    bucket = (
        F.when(c("w_all").isNull() | c("o_all").isNull(), "incomplete")
        .when((c("w_all") != c("w_any")) | (c("o_all") != c("o_any")), "mixed_across_repeats")
        .when(c("w_all") & ~c("o_all"), "passed_with_failed_without")
        .when(~c("w_all") & c("o_all"), "failed_with_passed_without")
        .when(c("w_all"), "passed_in_both")
        .otherwise("failed_in_both")
    )
    return agg.select("slug", "idx", bucket.alias("bucket"))


def line_count(body: Column) -> Column:
    """Lines of a text; an end of line at its very end begins no other."""
    lines = F.split(body, r"\R|[\x1C-\x1E]")
    return F.size(lines) - F.when(F.element_at(lines, -1) == "", 1).otherwise(0)


def grounded(evidence: Column, outputs: Column) -> Column:
    """Does the evidence point at outputs (a map from path to text)?

    It does with a quoted span of QUOTE characters, with any VERBATIM characters in a row
    that an output has too, both without regard to case and white space, or with a path and
    the number of a line that exists there.
    """
    quoted = F.transform(F.regexp_extract_all(evidence, F.lit(QUOTED), 1), fold)

    def quotes(text: Column) -> Column:
        return F.exists(quoted, lambda q: (F.char_length(q) >= QUOTE) & text.contains(q))

    def shares(text: Column) -> Column:
        own = fold(evidence)
        last = F.greatest(F.char_length(own) - VERBATIM + 1, F.lit(0))
        starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.exists(starts, lambda i: text.contains(F.substr(own, i, F.lit(VERBATIM))))

    def resolves(cited: Column) -> Column:
        path, line = F.regexp_extract(cited, CITED, 1), F.regexp_extract(cited, CITED, 2).try_cast("long")
        body = F.coalesce(F.try_element_at(outputs, path), F.try_element_at(outputs, F.regexp_replace(path, "^outputs/", "")))
        return F.coalesce(line.between(F.lit(1), line_count(body)), F.lit(False))

    cites = F.exists(F.regexp_extract_all(evidence, F.lit(CITED), 0), resolves)
    whole = F.array(fold(F.array_join(F.map_values(outputs), "\n")))
    return F.exists(whole, lambda text: (text != "") & (fold(evidence) != "") & (quotes(text) | shares(text) | cites))


def mechanical(assertion: Column) -> Column:
    """The scripted form of an assertion, or null: kind, arg (a path or a literal) and count."""

    def form(kind: str, pattern: str) -> Column:
        whole = f"(?iU)^\\s*{pattern}\\.?\\s*$"
        count = F.regexp_extract(assertion, whole, 2).try_cast("long") if kind == "line_count" else F.lit(None).cast("long")
        return F.when(assertion.rlike(whole), F.struct(F.lit(kind).alias("kind"), F.regexp_extract(assertion, whole, 1).alias("arg"), count.alias("count")))

    return F.coalesce(*(form(*f) for f in FORMS))


def run_mechanical(form: Column, outputs: Column) -> Column:
    """Verdict of a scripted assertion on outputs (a map from path to text); null for none.

    JSON is valid if Spark can parse it; the literals NaN and Infinity are not.
    """
    kind, arg = form["kind"], form["arg"]
    body = F.try_element_at(outputs, arg)
    present = F.exists(F.map_values(outputs), lambda text: text.contains(arg))
    return (
        F.when(kind == "file_exists", F.map_contains_key(outputs, arg))
        .when(kind == "valid_json", F.try_parse_json(body).isNotNull())
        .when(kind == "literal_present", present)
        .when(kind == "literal_absent", ~present)
        .when(kind == "line_count", F.coalesce(line_count(body) == form["count"], F.lit(False)))
    )


def enforce_evidence(results: DataFrame) -> DataFrame:
    """A pass without grounded evidence is a fail; results has outputs, a map from path to text."""
    ok = grounded(F.coalesce("evidence", F.lit("")), F.col("outputs"))
    return results.withColumn("grounded", ok).withColumn("passed", F.col("passed") & ok)


def run_status(expected: DataFrame, runs: DataFrame, errors: DataFrame) -> DataFrame:
    """Of each expected slug and arm: complete, error, incomplete or absent."""
    r = runs.groupBy("slug", "arm").agg(F.max("graded").alias("graded"))
    e = errors.select("slug", "arm", F.lit(True).alias("failed")).distinct()
    out = expected.join(r, ["slug", "arm"], "left").join(e, ["slug", "arm"], "left")
    status = F.when(F.col("graded"), "complete").when(F.col("failed"), "error").when(F.col("graded").isNotNull(), "incomplete").otherwise("absent")
    return out.select("slug", "arm", status.alias("status"))


#: Fewest authored evaluations of a skill, and of those fewest whose right answer is no.
AUTHORED, NEGATIVE = 7, 2


def is_negative(flag: Column, name: Column, expected: Column) -> Column:
    """Is the right answer of an evaluation no: by its flag, its name, or how the expected answer begins?"""
    named = F.coalesce(name.startswith("negative-") | name.contains("-negative-"), F.lit(False))
    return F.coalesce(flag, F.lit(False)) | named | F.coalesce(F.trim(expected).rlike(r"(?i)^no\b[\s—-]"), F.lit(False))


def authored(cases: DataFrame) -> DataFrame:
    """How many evaluations of each skill of cases(skill, negative) there are, and whether that is enough: skill, n, negatives, enough."""
    out = cases.groupBy("skill").agg(F.count(F.lit(1)).alias("n"), F.count_if("negative").alias("negatives"))
    return out.withColumn("enough", (F.col("n") >= AUTHORED) & (F.col("negatives") >= NEGATIVE))


def by_mechanism(results: DataFrame, *by: str) -> DataFrame:
    """Assertions of each run that a script decided and that a model decided, and how many of each passed."""
    scripted = F.col("mechanism") == "script"
    return results.groupBy(*by).agg(
        F.count_if(scripted).alias("scripted"), F.count_if(scripted & F.col("passed")).alias("scripted_passed"),
        F.count_if(~F.coalesce(scripted, F.lit(False))).alias("modelled"), F.count_if(~F.coalesce(scripted, F.lit(False)) & F.col("passed")).alias("modelled_passed"),
    )
