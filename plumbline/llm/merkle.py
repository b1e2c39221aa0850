"""Merkle manifests: a tree of digests over the rows of each group, one over the groups, and each row's proof.

Every level equijoins its nodes with the nodes at their computed sibling places; the rows at
slot zero of a run then emit the parents. All of it is joins and groupings of long keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import ascii_lower, join_counted, stage
from plumbline.llm.sharding import with_slots

FANOUT = 16
#: Columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:binary,after:binary>>"


def digest(*values: Column) -> Column:
    """Lower-case hex SHA-256 of the values' concatenation."""
    return F.sha2(F.concat(*values), 256)


def framed(value: Column) -> Column:
    """`-` for null, else the UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(**changed: Column) -> Column:
    """The digest of a row's fields, some of them changed."""
    return digest(*(framed(changed.get(c, F.col(c))) for c in FIELDS))


def _text(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def with_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """nodes(tree, at, n, digest and more) with before and after: the digests of the others of its run, in order.

    A run is fanout consecutive places of a tree, or what is left of it. A node at slot s
    asks for the slots s + 1, s + 2, ... around its run, each by an equijoin on the tree and
    the place; a node is asked for by fanout others at most, so no key is hot.
    """
    slot = F.col("at") % fanout
    size = F.least(F.lit(fanout).cast("long"), F.col("n") - (F.col("at") - slot))
    shift = F.explode(F.sequence(F.lit(1).cast("long"), F.col("size") - 1))
    asks = nodes.select("tree", "at", slot.alias("slot"), size.alias("size")).where("size > 1").select("*", shift.alias("shift"))
    asks = asks.select("tree", "at", (F.col("at") - F.col("slot") + (F.col("slot") + F.col("shift")) % F.col("size")).alias("sibling"))
    there = nodes.select("tree", F.col("at").alias("sibling"), F.col("digest").alias("other"))
    run = asks.join(there, ["tree", "sibling"]).groupBy("tree", "at").agg(F.array_sort(F.collect_list(F.struct("sibling", "other"))).alias("run"))

    def bytes_of(these: Column) -> Column:
        return F.coalesce(F.aggregate(these, F.lit(b""), lambda acc, x: F.concat(acc, x["other"])), F.lit(b""))

    before, after = (bytes_of(F.filter("run", f)) for f in (lambda x: x["sibling"] < F.col("at"), lambda x: x["sibling"] > F.col("at")))
    return nodes.join(run, ["tree", "at"], "left").select(*nodes.columns, before.alias("before"), after.alias("after"))


def climb(leaves: DataFrame, fanout: int = FANOUT) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """Build the trees over leaves(tree, at, n, digest and more): places from 0 to n - 1 in each tree, digests as binary.

    Returns for each level, from the leaves up, its nodes with their siblings and the nodes
    that are roots; then the roots left at the end. A tree of one leaf has that leaf as its
    root. The number of levels is the logarithm of the largest tree; each level is staged.
    """
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels, nodes = [], leaves
    while most > 1:
        level = stage(with_siblings(nodes.where("n > 1"), fanout), "level")
        levels.append((level, nodes.where("n = 1")))
        above = level.where(F.col("at") % fanout == 0)  # slot zero emits the parent
        run, n = F.concat(_text(F.col("digest")), _text(F.col("after"))), F.ceil(F.col("n") / fanout)
        nodes = stage(above.select("tree", (F.col("at") / fanout).cast("long").alias("at"), n.alias("n"), F.unhex(F.sha2(run, 256)).alias("digest")), "nodes")
        most = -(-most // fanout)
    return levels, nodes


def roots_of(levels: list[tuple[DataFrame, DataFrame]], last: DataFrame) -> DataFrame:
    """(tree, root) of climbed trees, root as binary."""
    tops = [x.select("tree", F.col("digest").alias("root")) for x in [*(ended for _, ended in levels), last]]
    return reduce(DataFrame.unionByName, tops)


def descend(levels: list[tuple[DataFrame, DataFrame]], last: DataFrame, tops: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The leaves of climbed trees, with path and the other columns of tops(tree, path and more).

    path: the siblings level by level from the leaf up, then those that tops has for the
    tree. Each node takes over its parent's path by an equijoin, so only the last one, of
    the leaves, handles as many rows as there are leaves, and its result is not shuffled.
    """
    more = [c for c in tops.columns if c != "tree"]
    found = last.join(tops, "tree")
    for level, ended in reversed(levels):
        kept = [c for c in level.columns if c not in ("before", "after")]
        up = found.select("tree", F.col("at").alias("up"), *more)
        here = level.withColumn("up", (F.col("at") / fanout).cast("long")).join(up, ["tree", "up"])
        path = F.concat(F.array(F.struct("before", "after")), "path")
        found = here.withColumn("path", path).select(*kept, *more).unionByName(ended.join(tops, "tree").select(*kept, *more))
    return found


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf (hex) and the siblings of its path lead to."""
    return F.aggregate(path, leaf, lambda acc, x: digest(_text(x["before"]), acc, _text(x["after"])))


def proof(path: Column) -> Column:
    """One digest over all siblings of a path, from the leaf up, left to right in each run."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(_text(x["before"]), _text(x["after"]))), ""), 256)


def manifest(docs: DataFrame, given: Column, fanout: int = FANOUT) -> DataFrame:
    """Check the rows that are given now against a manifest of docs.

    docs needs doc_id, source, lang, n_chars and text; other columns are ignored. given is
    the digest of the row as it is now (a Column over these fields, hex). Leaves of a source
    stand in the order of doc_id, null first; rows of one id in the order of their digests,
    and equal ones in any order: they have places and proofs of their own. Sources stand
    in the order of their UTF-8 bytes, null (a source of its own) first.
    Returns one row per row of docs: doc_id, leaf, subroot (of its source's tree), root,
    proof_sha256 (see proof; over the path to the subroot and on to the root, the digest of
    nothing where there is only one row), folded_root (where the given row and the original
    siblings lead) and verified (whether that is the root). An empty table gives an empty one.
    """
    docs = docs.select(*FIELDS)
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # null sorts first and joins like a value
    rows = docs.select("doc_id", key.alias("key"), F.unhex(leaf_of()).alias("leaf"), F.unhex(given).alias("given"), F.lit(0).alias("shard"))
    rows = with_slots(stage(rows, "leaves"), ["key", "doc_id", "leaf"])
    trees = stage(rows.groupBy("key").agg(F.min("slot").alias("first"), F.count(F.lit(1)).alias("n"), F.lit(0).alias("shard")), "trees")
    trees = stage(with_slots(trees, ["key"]).select("key", "first", "n", F.col("slot").alias("tree")), "trees")
    placed = join_counted(rows, trees, "key").select("doc_id", "leaf", "given", "tree", "n", (F.col("slot") - F.col("first")).alias("at"))
    placed = stage(placed.withColumnRenamed("leaf", "digest"), "placed")
    levels, last = climb(placed, fanout)
    subroots = stage(roots_of(levels, last), "subroots")

    sources = F.lit(trees.count()).cast("long")
    over = climb(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), sources.alias("n"), F.col("root").alias("digest")), fanout)
    none = F.array().cast(PATH)
    root = roots_of(*over).select("tree", none.alias("path"), _text(F.col("root")).alias("root"))  # of one row
    tops = descend(*over, root, fanout).select(F.col("at").alias("tree"), "path", "root", _text(F.col("digest")).alias("subroot"))

    out = descend(levels, last, stage(tops, "tops"), fanout)
    leaf, path = _text(F.col("digest")), F.col("path")
    out = out.select("doc_id", leaf.alias("leaf"), "subroot", "root", proof(path).alias("proof_sha256"), folded(_text(F.col("given")), path).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(every: int = 5) -> Column:
    """The digest of a row whose text has lost its capitals A-Z, where `every` divides the CRC-32 of its decimal doc_id; else of the row itself."""
    hit = F.crc32(F.col("doc_id").cast("string")) % every == 0
    return F.when(hit, leaf_of(text=ascii_lower(F.col("text")))).otherwise(leaf_of())


def _levels(n: int) -> str:
    """n levels of trees over l0(tree, ix, n, d, leaf rows r): nodes, then the paths of the leaves."""
    out = []
    for i in range(n):
        out.append(
            f"""s{i} AS MATERIALIZED (SELECT tree, ix, n, d,
  coalesce(string_agg(d, '') OVER (PARTITION BY tree, ix // 16 ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
  coalesce(string_agg(d, '') OVER (PARTITION BY tree, ix // 16 ORDER BY ix ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM l{i}),
l{i + 1} AS MATERIALIZED (SELECT tree, ix // 16 AS ix, (any_value(n) + 15) // 16 AS n,
  CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY ix)) END AS d FROM l{i} GROUP BY tree, ix // 16),
p{i + 1} AS MATERIALIZED (SELECT p.r, p.tree, p.ix // 16 AS ix, CASE WHEN s.n = 1 THEN f ELSE sha256(s.b || f || s.a) END AS f,
  CASE WHEN s.n = 1 THEN proof ELSE proof || s.b || s.a END AS proof FROM p{i} p JOIN s{i} s ON p.tree = s.tree AND p.ix = s.ix)"""
        )
    return ",\n".join(out)


#: Levels that the SQL unrolls: enough for 16 to that power of rows.
SQL_LEVELS = 6
_FRAMED = " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in FIELDS)
#: CRC-32 of a decimal number, bit by bit.
_STEP = "lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
CRC32_SQL = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform({{bytes}}, lambda y: y::BIGINT)), lambda e, y: list_reduce(list_prepend(xor(e, y), range(8)), {_STEP})), 4294967295)"
_CRC = CRC32_SQL.format(bytes="list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x))")
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = f"""WITH leaves AS MATERIALIZED (SELECT doc_id, source, sha256({_FRAMED}) AS leaf,
  CASE WHEN doc_id IS NOT NULL AND {_CRC} % 5 = 0 THEN sha256({_FRAMED.replace("text::VARCHAR", f"{_LOW}")}) ELSE sha256({_FRAMED}) END AS given FROM documents),
placed AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS r,
  dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS ix, count(*) OVER (PARTITION BY source) AS n FROM leaves),
l0 AS (SELECT tree, ix, n, leaf AS d FROM placed), p0 AS (SELECT r, tree, ix, given AS f, '' AS proof FROM placed),
{_levels(SQL_LEVELS)},
subs AS MATERIALIZED (SELECT tree, d FROM l{SQL_LEVELS}),
done AS MATERIALIZED (SELECT r, tree, f, proof FROM p{SQL_LEVELS}),
top AS (WITH l0 AS (SELECT 0 AS tree, tree AS ix, (SELECT count(*) FROM subs) AS n, d FROM subs), p0 AS (SELECT r, 0 AS tree, tree AS ix, f, proof FROM done),
{_levels(SQL_LEVELS)} SELECT p.r, p.f, p.proof, l.d AS root FROM p{SQL_LEVELS} p, l{SQL_LEVELS} l)
SELECT doc_id, leaf, s.d AS subroot, t.root, sha256(t.proof) AS proof_sha256, t.f AS folded_root, t.f = t.root AS verified
FROM placed JOIN subs s USING (tree) JOIN top t USING (r)"""
