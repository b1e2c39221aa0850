"""Mixing sources by temperature, in DataFrame operations only.

Sources get weights in proportion to share ** t, with t between 0 (all alike) and 1 (as
they are), searched by section so that the weights reach a target entropy, and raised
where a source would be repeated too often. Each source then gets its weight's part of a
token budget: whole passes over its blocks, and a last pass that follows a permutation of
the blocks and breaks off, in a permutation of the last block's documents, at the budget.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.llm.common import broadcast_if_small, stage

#: Target entropy as a share of the most possible, most passes over a source, budget as a
#: multiple of all tokens.
ENTROPY, REPEATS, BUDGET = 0.95, 4.0, 1.0
#: Tokens of a block.
BLOCK = 100_000
SEED = "mix"
_SECTIONS, _ROUNDS = 64, 5
#: A source's permutation of blocks is cut into 2 to this power of pieces.
_PIECE_BITS = 12


def _hash(*parts: Column) -> Column:
    """A long from the first 60 bits of an MD5 digest."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def _block(source_blocks: Column) -> Column:
    return F.pmod(_hash(F.lit(f"{SEED}:block"), F.col("key")), source_blocks)


def _key() -> Column:
    """What a document is told by: its id and its text, so that rows of one id, or of none, go their own ways."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))


def _source() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def _search(shares: DataFrame, ok: str) -> float | None:
    """The largest t for which ok holds, as far as the sections tell; None if it fails at 0. ok reads z, s and most."""
    low, width = 0.0, 1.0
    for _ in range(_ROUNDS):
        ts = shares.sparkSession.range(_SECTIONS + 1).select((F.lit(low) + F.col("id") * (width / _SECTIONS)).alias("t"))
        sums = shares.crossJoin(F.broadcast(ts)).groupBy("t").agg(  # 65 rows
            F.sum(F.pow("p", "t")).alias("z"), F.sum(F.pow("p", "t") * F.log("p")).alias("s"), F.max(F.pow("p", F.col("t") - 1)).alias("most")
        )
        best = sums.where(ok).agg(F.max("t")).first()[0]
        if best is None:
            return None
        low, width = best, width / _SECTIONS
        if low >= 1:
            return 1.0
    return low


def temperature(shares: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float = BUDGET) -> float:
    """The exponent for shares(p): as near to 1 as the entropy target lets it, and beyond where repeats asks for it.

    Entropy falls and repetition falls as t grows. If the target entropy cannot be reached, t is 0;
    if no exponent meets repeats (the budget alone asks for more), t is 1.
    """
    n = shares.count()
    if n < 2:
        return 1.0
    by_entropy = _search(shares, f"ln(z) - t * s / z >= {entropy!r} * ln({n})") or 0.0
    too_often = _search(shares, f"most / z * {budget!r} > {repeats!r}")
    if too_often is None:
        return by_entropy
    return max(by_entropy, min(1.0, too_often + float(_SECTIONS) ** -_ROUNDS))


@dataclass
class MixingPlan:
    """blocks of each source, and the passes over each block."""

    sources: DataFrame  # source, tokens, weight, target, blocks
    passes: DataFrame  # source, block, epoch, block_rank, most (hash of the last document of a broken-off block)


def plan(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float = BUDGET) -> MixingPlan:
    """Work out the mix of docs(doc_id, text, source). Tokens are runs without white space."""
    tokens = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = stage(docs.select(_key().alias("key"), _source().alias("source"), tokens.alias("n")), "tokens")
    sums = stage(rows.groupBy("source").agg(F.sum("n").alias("tokens")).where("tokens > 0"), "sources")
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    shares = sums.select("source", "tokens", (F.col("tokens").cast("double") / float(total or 1)).alias("p"))
    t = temperature(shares, entropy, repeats, budget)
    z = shares.agg(F.sum(F.pow("p", F.lit(t)))).first()[0] or 1.0
    weight = F.pow("p", F.lit(t)) / F.lit(z)
    blocks = F.ceil(F.col("tokens") / BLOCK).cast("long")
    sources = shares.select("source", "tokens", weight.alias("weight"), F.floor(weight * (total * budget)).alias("target"), blocks.alias("blocks"))
    sources = stage(sources, "mix")

    dealt = rows.join(broadcast_if_small(sources), "source").withColumn("block", _block(F.col("blocks")))
    held = stage(dealt.groupBy("source", "block", "tokens", "target").agg(F.sum("n").alias("n")), "blocks")
    # epochs 0 to target / tokens, the last one broken off
    epochs = held.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("target") / F.col("tokens")))))
    ranked = _in_turn(epochs)
    left = F.col("target") - F.col("epoch") * F.col("tokens") - (F.col("upto") - F.col("n"))
    ranked = stage(ranked.withColumn("left", left).where("left > 0").select("source", "block", "epoch", "block_rank", "n", "left"), "ranked")
    # of each source at most one block is broken off
    broken = ranked.where("n > left").select("source", "block", "epoch", "left")
    inside = dealt.select("source", "block", "key", "n").join(broadcast_if_small(broken), ["source", "block"]).withColumn("h", _order())
    so_far = F.sum("n").over(W.partitionBy("source", "block", "epoch").orderBy("h").rangeBetween(W.unboundedPreceding, 0))
    cut = inside.withColumn("so_far", so_far).where("so_far <= left").groupBy("source", "block", "epoch").agg(F.max("h").alias("most"))
    passes = ranked.join(broadcast_if_small(stage(cut, "cut")), ["source", "block", "epoch"], "left")
    passes = passes.select("source", "block", "epoch", "block_rank", F.when(F.col("n") > F.col("left"), F.coalesce("most", F.lit(-1))).alias("most"))
    return MixingPlan(sources, stage(passes, "passes"))


def _in_turn(epochs: DataFrame) -> DataFrame:
    """epochs(source, epoch, block, n and more) with block_rank, the block's place in its permutation, and upto, the tokens up to its end.

    A permutation is cut into pieces by the blocks' hashes. Running sums are taken within the
    pieces and over the pieces' sums, so no task orders all blocks of a source.
    """
    turn = _hash(F.lit(f"{SEED}:turn"), F.col("source"), F.col("epoch"), F.col("block"))
    cut = stage(epochs.withColumn("turn", turn).withColumn("piece", F.shiftright("turn", 60 - _PIECE_BITS)), "turns")
    before = W.partitionBy("source", "epoch").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    sums = cut.groupBy("source", "epoch", "piece").agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_rows"))
    sums = sums.select("source", "epoch", "piece", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_n", "_rows")))
    piece = W.partitionBy("source", "epoch", "piece").orderBy("turn", "block")
    out = cut.join(broadcast_if_small(stage(sums, "pieces")), ["source", "epoch", "piece"])
    rank = F.row_number().over(piece).cast("long") - 1 + F.col("_rows")
    upto = F.sum("n").over(piece.rowsBetween(W.unboundedPreceding, 0)) + F.col("_n")
    return out.select(*epochs.columns, rank.alias("block_rank"), upto.alias("upto"))


def _order() -> Column:
    """A document's place in its block in a broken-off pass."""
    return _hash(F.lit(f"{SEED}:doc"), F.col("epoch"), F.col("key"))


def mixed(docs: DataFrame, p: MixingPlan, *carry: str) -> DataFrame:
    """A row for each pass over each document: the carried columns of docs, and epoch, block and block_rank.

    docs needs doc_id, text and source; a plan of the same documents gives the budgeted tokens.
    """
    rows = docs.select(F.struct(*carry).alias("_row"), _key().alias("key"), _source().alias("source"))
    rows = rows.join(broadcast_if_small(p.sources.select("source", "blocks")), "source").withColumn("block", _block(F.col("blocks")))
    rows = rows.join(broadcast_if_small(p.passes), ["source", "block"])
    return rows.where(F.col("most").isNull() | (_order() <= F.col("most"))).select("_row.*", "epoch", "block", "block_rank")


def mix_sources(docs: DataFrame) -> DataFrame:
    """The mix of all documents: doc_id, source, epoch, block, block_rank.

    docs needs doc_id (long), text and source; other columns are ignored, whatever their
    names. The result has a row for each pass that a document is in; in the order of
    epoch, block_rank within a source, its tokens add up to the source's budget, less than
    one document short. A null source is the source '', and comes back as it was. A source
    without tokens has no weight and no rows; a document without tokens goes with its
    block. Rows with the same doc_id (nulls count as '') and the same text share their block and
    place, so of a broken-off pass all of them are there or none; other rows of one id, or of
    none, are dealt on their own. An empty table gives an empty one.
    """
    p = plan(docs)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    return mixed(src, p, "doc_id", "source")


def _sql_hash(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 15))::BIGINT"


def _sql_search(name: str, ok: str) -> str:
    """CTEs of the rounds of one search: the largest t found after each."""
    out, low, width = [], "SELECT 0.0::DOUBLE AS low", 1.0
    for i in range(_ROUNDS):
        out.append(
            f"""{name}{i} AS (
  SELECT max(t) AS low FROM (
    SELECT t, sum(pow(p, t)) AS z, sum(pow(p, t) * ln(p)) AS s, max(pow(p, t - 1)) AS most
    FROM p, (SELECT low + i * {width / _SECTIONS!r}::DOUBLE AS t FROM ({low}), (SELECT unnest(range({_SECTIONS + 1})) AS i)) GROUP BY t)
  WHERE t <= 1 AND {ok})"""
        )
        low, width = f"SELECT low FROM {name}{i}", width / _SECTIONS
    return ",\n".join(out)


_SQL = f"""
WITH d AS (
  SELECT doc_id, {{source}} AS source, coalesce({{source}}, '') AS src, concat_ws(':', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, ''))) AS key,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n FROM documents),
tot AS (SELECT src, sum(n)::BIGINT AS tokens FROM d GROUP BY src HAVING sum(n) > 0),
p AS (SELECT src, tokens, tokens::DOUBLE / (SELECT sum(tokens) FROM tot)::DOUBLE AS p FROM tot),
{_sql_search("e", f"ln(z) - t * s / z >= {ENTROPY!r}::DOUBLE * ln((SELECT count(*) FROM p))")},
{_sql_search("o", f"most / z * {BUDGET!r}::DOUBLE > {REPEATS!r}::DOUBLE")},
temp AS (
  SELECT CASE WHEN (SELECT count(*) FROM p) < 2 THEN 1.0::DOUBLE
    ELSE greatest(coalesce((SELECT low FROM e{_ROUNDS - 1}), 0), (SELECT CASE WHEN low IS NULL THEN 0 ELSE least(1.0, low + {float(_SECTIONS) ** -_ROUNDS!r}::DOUBLE) END FROM o{_ROUNDS - 1})) END AS t),
w AS (
  SELECT src, tokens, ceil(tokens / {BLOCK})::BIGINT AS blocks,
         floor(pow(p, t) / (SELECT sum(pow(p, t)) FROM p, temp) * ((SELECT sum(tokens) FROM tot) * {BUDGET!r}::DOUBLE))::BIGINT AS target FROM p, temp),
x AS (SELECT d.*, tokens, target, {_sql_hash(f"'{SEED}:block'", "key")} % blocks AS block FROM d JOIN w USING (src)),
b AS (SELECT src, block, tokens, target, sum(n)::BIGINT AS n FROM x GROUP BY ALL),
ep AS (SELECT *, unnest(range((target // tokens) + 1)) AS epoch FROM b),
r AS (
  SELECT *, row_number() OVER turn - 1 AS block_rank, target - epoch * tokens - (sum(n) OVER turn - n) AS left_over FROM ep
  WINDOW turn AS (PARTITION BY src, epoch ORDER BY {_sql_hash(f"'{SEED}:turn'", "src", "epoch", "block")}, block ROWS UNBOUNDED PRECEDING)),
y AS (
  SELECT x.doc_id, x.source, r.epoch, x.block, r.block_rank, r.n > r.left_over AS broken, r.left_over,
         sum(x.n) OVER (PARTITION BY x.src, x.block, r.epoch ORDER BY {_sql_hash(f"'{SEED}:doc'", "r.epoch", "x.key")} RANGE UNBOUNDED PRECEDING) AS so_far
  FROM x JOIN r ON x.src = r.src AND x.block = r.block WHERE r.left_over > 0)
SELECT doc_id, source, epoch, block, block_rank FROM y WHERE NOT broken OR so_far <= left_over
"""


def oracle_sql(source: str = "source") -> str:
    """SQL of the mix of documents by one of its columns."""
    return _SQL.format(source=source)
