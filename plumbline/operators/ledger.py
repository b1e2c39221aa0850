"""Judgments that were attempted and did not pool: from the scorecards, from what they record themselves, and from the ledger of old ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators.markdown import tables_with

# --- fixed values ---
STATUSES = ["failed", "malformed"]
# --- end of fixed values ---

KEY = ["skill", "provider", "round"]


def _of(path: str, kind: str) -> Column:
    return F.try_variant_get("card", path, kind)


def _list(path: str) -> Column:
    return F.coalesce(_of(path, "array<variant>"), F.array().cast("array<variant>"))


def _whole(value: Column) -> Column:
    """A value that is an integer, else null."""
    return F.when(F.schema_of_variant(value) == "BIGINT", F.try_variant_get(value, "$", "int"))


def cards(parsed: DataFrame) -> DataFrame:
    """Scorecards of parsed(corpus, file, card): those with judgments and providers, and what they say of themselves.

    corpus, file, skill, rounds, providers, judged (the providers of the judgments, in order),
    attempted (stated, or else rounds times providers), pooled, modern (it states what it
    attempted), refusals (its own list, null without one).
    """
    held = parsed.where(F.col("card").isNotNull() & _of("$.judgments", "variant").isNotNull() & _of("$.providers", "variant").isNotNull())
    stated, providers = _whole(_of("$.attempted", "variant")), F.coalesce(_of("$.providers", "array<string>"), F.array().cast("array<string>"))
    judged = F.transform(_list("$.judgments"), lambda j: F.try_variant_get(j, "$.provider", "string"))
    rounds = F.coalesce(_of("$.rounds", "int"), F.lit(0))
    return held.select(
        "corpus", "file", F.coalesce(_of("$.skill", "string"), F.lit("?")).alias("skill"), rounds.alias("rounds"), providers.alias("providers"), judged.alias("judged"),
        F.coalesce(stated, rounds * F.size(providers)).alias("attempted"), F.size(judged).alias("pooled"), stated.isNotNull().alias("modern"), _of("$.refusals", "array<variant>").alias("refusals"),
    )


def segments(found: DataFrame) -> DataFrame:
    """A row for each judgment of cards: corpus, file, provider, segment (the round it stands in, from 1, null where that cannot be told).

    A provider whose place on the roster is not after its predecessor's opens a segment. Only
    if there are as many segments as rounds, and no judge is off the roster, are they the rounds.
    """
    rows = found.select("corpus", "file", "rounds", "providers", F.posexplode("judged").alias("pos", "provider"))
    rows = rows.withColumn("ix", F.nullif(F.array_position("providers", F.col("provider")), F.lit(0)))
    in_turn, card = W.partitionBy("corpus", "file").orderBy("pos"), W.partitionBy("corpus", "file")
    opens = F.when(F.lag("ix").over(in_turn) < F.col("ix"), 0).otherwise(1)
    rows = rows.withColumn("opens", opens).withColumn("segment", F.sum("opens").over(in_turn.rowsBetween(W.unboundedPreceding, 0)))
    sound = (F.max("segment").over(card) == F.col("rounds")) & (F.count(F.when(F.col("ix").isNull(), 1)).over(card) == 0)
    return rows.select("corpus", "file", "provider", F.when(sound, F.col("segment")).alias("segment"))


def missing(found: DataFrame) -> DataFrame:
    """The attempts that left no judgment, one row each: corpus, file, skill, provider, round (null where it cannot be told)."""
    short = found.where("attempted > pooled")
    placed = segments(short)
    known = placed.groupBy("corpus", "file").agg(F.bool_and(F.col("segment").isNotNull()).alias("known"))
    base = short.join(known, ["corpus", "file"], "left").select("corpus", "file", "skill", "rounds", "providers", F.coalesce("known", F.lit(False)).alias("known"))
    grid = base.where("known").select("corpus", "file", "skill", F.explode("providers").alias("provider"), "rounds").withColumn("round", F.explode(F.sequence(F.lit(1), "rounds")))
    by_round = grid.join(placed.select("corpus", "file", "provider", F.col("segment").cast("int").alias("round")), ["corpus", "file", "provider", "round"], "left_anti")
    held = placed.groupBy("corpus", "file", "provider").agg(F.count(F.lit(1)).alias("n"))
    loose = base.where("NOT known").select("corpus", "file", "skill", F.explode("providers").alias("provider"), "rounds").join(held, ["corpus", "file", "provider"], "left")
    gap = F.greatest(F.lit(0), F.col("rounds") - F.coalesce("n", F.lit(0)).cast("int"))
    by_count = loose.withColumn("_", F.explode(F.array_repeat(F.lit(0), gap))).withColumn("round", F.lit(None).cast("int"))
    cols = ["corpus", "file", *KEY]
    return by_round.select(*cols).unionByName(by_count.select(*cols))


def recorded(found: DataFrame) -> DataFrame:
    """The refusals that cards record about themselves: corpus, file, at, skill, provider, round, problems."""
    rows = found.where("modern").select("corpus", "file", F.col("skill").alias("own"), F.posexplode("refusals").alias("at", "r"))
    get = lambda path, kind="string": F.try_variant_get("r", path, kind)
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    number = _whole(get("$.round", "variant"))
    chars = F.coalesce(get("$.response_chars", "double"), F.lit(0.0))
    problems = F.array_compact(
        F.array(
            F.when(blank(get("$.provider")), "names no provider"), F.when(blank(get("$.skill")), "names no skill"), F.when(number.isNull(), "names no round"),
            F.when(~F.coalesce(get("$.status").isin(STATUSES), F.lit(False)), F.concat(F.lit("has the status "), F.coalesce(get("$.status"), F.lit("none")))), F.when(blank(get("$.reason")), "gives no reason"),
            F.when((chars > 0) & blank(get("$.response_excerpt")), "kept nothing of the response"),
        )
    )
    return rows.select("corpus", "file", "at", F.coalesce(get("$.skill"), "own").alias("skill"), F.coalesce(get("$.provider"), F.lit("?")).alias("provider"), number.alias("round"), problems.alias("problems"))


def ledger_rows(texts: DataFrame) -> DataFrame:
    """The attempts that the ledger texts(doc, text) list, in all tables headed skill, provider, round."""
    rows = tables_with(texts, "skill", "provider", "round").where(F.size("cells") >= 3)
    cell = lambda i: F.get("cells", F.lit(i))
    return rows.select(cell(0).alias("skill"), cell(1).alias("provider"), F.when(cell(2).rlike(r"^\d{1,9}$"), F.try_to_number(cell(2), F.lit("999999999")).cast("int")).alias("round"))


def ledger_totals(texts: DataFrame) -> DataFrame:
    """The totals by corpus that ledger texts state: corpus, attempted, pooled, refused; rows that hold no numbers are left out."""
    rows = tables_with(texts, "corpus", "attempted", "pooled", "refused").where(F.size("cells") >= 4)
    n = lambda i: F.get("cells", F.lit(i)).try_cast("int")
    name = F.regexp_replace(F.regexp_replace(F.get("cells", F.lit(0)), "^`+|`+$", ""), "/+$", "")
    return rows.select(name.alias("corpus"), n(1).alias("attempted"), n(2).alias("pooled"), n(3).alias("refused")).where("attempted IS NOT NULL AND pooled IS NOT NULL AND refused IS NOT NULL")


def _key(*cols: str) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("?")).alias(c) for c in cols]


def problems(found: DataFrame, ledger: DataFrame) -> DataFrame:
    """All that is not accounted for, between found (cards) and ledger texts(doc, text), both ways: corpus, file, kind, detail.

    Kinds: no-attempts and overfull cards; no-refusals (attempts are stated and lost, and
    there is no list of them); entry (a refusal that cannot be acted on); count and mismatch
    (recorded refusals against the attempts that are missing, as multisets); unrecorded (an
    old card's missing attempt is not in the ledger); corpus-unlisted and corpus-totals; and
    phantom (a row of the ledger that no card misses).
    """
    gap = F.col("attempted") - F.col("pooled")
    sized = found.withColumn("gap", gap)
    out = lambda rows, kind, detail, file="file": rows.select("corpus", (F.col(file) if file else F.lit(None).cast("string")).alias("file"), F.lit(kind).alias("kind"), detail.cast("string").alias("detail"))
    parts = [
        out(sized.where("attempted = 0"), "no-attempts", F.lit("neither rounds nor providers")),
        out(sized.where("attempted <> 0 AND gap < 0"), "overfull", F.concat("pooled", F.lit(" of "), "attempted")),
        out(sized.where("gap > 0 AND modern AND refusals IS NULL"), "no-refusals", F.concat("gap", F.lit(" lost"))),
    ]
    sound = sized.where("attempted <> 0 AND gap >= 0")
    own = recorded(sound.where("refusals IS NOT NULL"))
    parts.append(out(own.select("corpus", "file", "at", F.explode("problems").alias("p")), "entry", F.concat(F.lit("refusal "), "at", F.lit(" "), "p")))
    told = own.groupBy("corpus", "file").agg(F.count(F.lit(1)).alias("n"))
    counted = sound.where("modern AND refusals IS NOT NULL").join(told, ["corpus", "file"], "left")
    parts.append(out(counted.where(F.coalesce("n", F.lit(0)) != F.col("gap")), "count", F.concat("gap", F.lit(" lost, "), F.coalesce("n", F.lit(0)), F.lit(" recorded"))))
    derived = missing(sound)
    key = ["corpus", "file", *KEY]
    lost = derived.join(sound.where("modern AND refusals IS NOT NULL").select("corpus", "file"), ["corpus", "file"], "left_semi")
    a = lost.select("corpus", "file", *_key(*KEY)).groupBy(*key).agg(F.count(F.lit(1)).alias("derived"))
    b = own.select("corpus", "file", *_key(*KEY)).groupBy(*key).agg(F.count(F.lit(1)).alias("recorded"))
    short = lost.select("corpus", "file").distinct()  # only where attempts can be derived
    both = a.join(b.join(short, ["corpus", "file"], "left_semi"), key, "full_outer").na.fill(0, ["derived", "recorded"]).where("derived <> recorded")
    parts.append(out(both, "mismatch", F.concat(F.concat_ws(" ", *KEY), F.lit(": "), "derived", F.lit(" missing, "), "recorded", F.lit(" recorded"))))
    rows = ledger_rows(ledger)
    old = sound.where("NOT modern AND gap > 0")
    unlisted = derived.join(old.select("corpus", "file"), ["corpus", "file"], "left_semi").select("corpus", "file", *_key(*KEY)).join(rows.select(*_key(*KEY)), KEY, "left_anti")
    parts.append(out(unlisted, "unrecorded", F.concat_ws(" ", *KEY)))
    sums = sized.groupBy("corpus").agg(F.sum("attempted").alias("a"), F.sum("pooled").alias("p"), F.bool_or(~F.col("modern") & (F.col("gap") > 0)).alias("needs")).where("needs")
    stated = sums.join(ledger_totals(ledger), "corpus", "left")
    parts.append(out(stated.where("attempted IS NULL"), "corpus-unlisted", F.concat(F.col("a") - F.col("p"), F.lit(" lost")), None))
    wrong = stated.where("attempted IS NOT NULL AND (attempted <> a OR pooled <> p OR refused <> a - p)")
    parts.append(out(wrong, "corpus-totals", F.concat(F.concat_ws("/", "attempted", "pooled", "refused"), F.lit(" stated, "), F.concat_ws("/", "a", "p", F.col("a") - F.col("p")), F.lit(" in the files")), None))
    phantom = rows.select(*_key(*KEY)).join(missing(sized).select(*_key(*KEY)), KEY, "left_anti").withColumn("corpus", F.lit(None).cast("string"))
    parts.append(out(phantom, "phantom", F.concat_ws(" ", *KEY), None))
    return reduce(DataFrame.unionByName, parts)


def report(found: DataFrame) -> DataFrame:
    """Totals by corpus, then every missing attempt: corpus, skill, provider, round, attempted, pooled, refused; totals have no skill."""
    totals = found.groupBy("corpus").agg(F.sum("attempted").alias("attempted"), F.sum("pooled").alias("pooled"), F.sum(F.col("attempted") - F.col("pooled")).alias("refused"))
    return totals.unionByName(missing(found).select("corpus", *KEY), allowMissingColumns=True).select("corpus", *KEY, "attempted", "pooled", "refused")
