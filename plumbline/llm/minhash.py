"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, components.

SuperMinHash (Ertl 2017) gives each shingle one random permutation of the signature's
positions and correlated ranks along it. The ranks are worked off one by one for all
shingles of a batch at once; a document stops as soon as its largest rank can no longer
fall, which for long documents is after the first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import broadcast_if_small, join_counted, numbered, small_batches, stage
from plumbline.llm.components import connected_components
from plumbline.llm.textkit import chunks, mix, shingles_of, words_of

_U = np.uint64
_GAMMA = 0x9E3779B97F4A7C15

#: Positions of a signature, and its bands: at a similarity of 0.8 a pair is missed with
#: probability (1 - 0.8^5)^32 = 3e-6, at 0.85 with 7e-9.
POSITIONS, ROWS = 160, 5
#: Rounds in which classes are verified against one class of the largest component in each of their buckets.
HUB_ROUNDS = 2
#: Sizes of sets are told apart by this ratio in the exact search.
SIZE_STEP = 1.01
#: A pair whose signatures agree on less than the threshold minus this is not verified
#: (Hoeffding at 160 positions: a miss has probability below 3e-7).
MARGIN = 0.22


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures, (documents, m), of sets of shingle hashes; an empty set has all bits set.

    A value holds the rank in its upper 32 bits and the random fraction below.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    out = np.full(len(sets) * m, np.iinfo(np.uint64).max, dtype=np.uint64)
    if not sizes.sum():
        return out.reshape(len(sets), m)
    h = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), sizes)
    perm = None
    for j in range(m):
        x = mix(h + _U((j + 1) * _GAMMA & (2**64 - 1)))
        k = j + (((x >> _U(32)) * _U(m - j)) >> _U(32)).astype(np.int64)
        if perm is None:
            at = k
        else:
            row = np.arange(len(h))
            at = perm[row, k].astype(np.int64)
            perm[row, k] = perm[row, j]
        np.minimum.at(out, doc * m + at, (x & _U(0xFFFFFFFF)) | (_U(j) << _U(32)))
        most = out.reshape(len(sets), m).max(axis=1)
        live = (most >= _U((j + 1) << 32)) & (sizes > 0)
        keep = live[doc]
        if not keep.any():
            break
        if perm is None:
            h, doc, k = h[keep], doc[keep], k[keep]
            perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(h), 1))
            perm[np.arange(len(h)), k] = 0
        elif not keep.all():
            h, doc, perm = h[keep], doc[keep], perm[keep]
    return out.reshape(len(sets), m)


#: The name that numbered() gives a row.
ROW = T.StructType([T.StructField("file", T.LongType()), T.StructField("at", T.LongType())])
SIGNED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("row", ROW),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("set_key", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("marks", T.BinaryType()),
    ]
)


def _sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    words, bounds = words_of(texts)
    return [shingles_of(words[a:b], k) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _signer(k: int):
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in chunks(texts):
                sets = _sets(texts[a:b], k)
                sig = signatures(sets, POSITIONS)
                bands = np.zeros((len(sets), POSITIONS // ROWS), dtype=np.uint64)
                for r in range(ROWS):
                    bands = mix(bands * _U(3) + sig[:, r::ROWS])
                bands = mix(bands + np.arange(POSITIONS // ROWS, dtype=np.uint64))
                marks = mix(sig).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(a, b - a) for c in range(2)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([x if len(s) else None for x, s in zip(bands.view(np.int64), sets, strict=True)], pa.list_(pa.int64())),
                        pa.array([x.tobytes() if len(s) else None for x, s in zip(marks, sets, strict=True)], pa.binary()),
                    ],
                    names=SIGNED.names,
                )

    return signed


def _set_maker(k: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([s.view(np.int64) for s in _sets(texts[a:b], k)], pa.list_(pa.int64()))],
                    names=["node", "items"],
                )

    return made


@F.pandas_udf(T.DoubleType())
def _agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of equal positions of two signatures."""
    x, y = (np.frombuffer(b"".join(s), np.uint16).reshape(len(s), -1) for s in (a, b))
    return pd.Series((x == y).mean(axis=1) if len(a) else [], dtype="float64")


def _buckets(bands: DataFrame) -> DataFrame:
    """(bucket, node, low, n) of the buckets with more than one class, n of them."""
    found = bands.select(F.explode("bands").alias("bucket"), "node")
    sized = found.groupBy("bucket").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return join_counted(found, stage(sized, "sized"), "bucket")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, row: str | None = None) -> DataFrame:
    """Group documents whose sets of k-word shingles have a Jaccard similarity of percent/100 or more.

    docs needs doc_id (long) and text; other columns are ignored, whatever their names.
    Returns one row per row of docs: doc_id, n_shingles (distinct shingles), component_id
    (smallest doc_id of the group, by links of any length) and kept (the row's doc_id is
    that smallest). Sets: words are lower-cased (A-Z) runs without white space over the whole
    text; a text of fewer than k words is one shingle; a null, empty or blank text has no
    shingle and stays alone. Repeated rows share a component. A null doc_id takes part in
    grouping but is never the smallest unless the whole group has none, and then kept is
    true. An empty table gives an empty one. With row, a column of docs that names each row
    (see numbered), the result also has that column and chosen: true for exactly one row of
    each group, the least by doc_id (null last) and row, and for each row without a shingle.

    Copies (equal sets) are folded into classes first. Candidates are classes that share a
    band. Each class is verified against the smallest class of that bucket with which it
    shares most bands, and then, round by round, against one class of the largest component
    in each of its buckets. The classes whose buckets still hold a larger component than
    theirs are searched for among all classes of such buckets, exactly (see _search), so
    that no link between different texts is lost and no component is expanded into pairs.
    """
    small_batches(docs.sparkSession)
    docs = docs if row else numbered(docs)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(row or "_row").cast(ROW).alias("row"), "text")
    signed = stage(src.mapInArrow(_signer(k), SIGNED), "signed")
    classes = (
        signed.where("set_key IS NOT NULL")
        .groupBy("set_key")
        .agg(
            F.min("doc_id").alias("low_id"),
            F.count(F.lit(1)).alias("copies"),
            F.first("bands").alias("bands"),
            F.first("marks").alias("marks"),
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"),
        )
        .withColumn("node", F.monotonically_increasing_id())
    )
    classes = stage(classes, "classes")  # node numbers hold from here on

    buckets = stage(_buckets(classes.select("node", "bands")), "buckets")
    in_bucket = buckets.select("node").distinct()
    sets = _candidate_sets(src, stage(classes.join(in_bucket, "node", "left_semi").select("node", "first.row"), "wanted"), k)
    stars = buckets.where("node > low").groupBy(F.col("low").alias("a"), F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    nearest = stars.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a"))
    parts = stage(connected_components(_verified(nearest, classes, sets, percent)), "parts")
    mixed = buckets
    for turn in range(HUB_ROUNDS + 1):
        mixed = stage(_mixed(mixed.select("bucket", "node"), parts, turn), "mixed")  # a settled bucket stays settled
        if not mixed.take(1):
            break
        if turn < HUB_ROUNDS:
            pairs = mixed.where("mine < top").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
        else:
            pairs = _search(mixed, sets, percent)
        # what the search lists is so similar that signatures would rule out hardly a pair
        more = stage(_verified(pairs, classes, sets, percent) if turn < HUB_ROUNDS else _similar(pairs, sets, percent), "links")
        if more.take(1):
            parts = stage(connected_components(parts.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(more)), "parts")

    # only classes with copies or links need a look-up; all others stand for themselves
    named = classes.join(parts, "node", "left").select(
        "set_key", "low_id", "first", "copies", F.coalesce("root", "node").alias("root"), F.col("root").isNotNull().alias("linked")
    )
    lows = named.where("linked").groupBy("root").agg(F.min("low_id").alias("least_id"), F.min("first").alias("least"))
    known = named.where("linked OR copies > 1").join(lows, "root", "left")
    known = known.select("set_key", "copies", F.coalesce("least_id", "low_id").alias("least_id"), F.coalesce("least", "first")["row"].alias("least"), F.lit(True).alias("known"))
    out = join_counted(signed.select("doc_id", "row", "n_shingles", "set_key"), stage(known, "known"), "set_key", "copies", "left")
    component = F.when(F.col("known"), F.col("least_id")).otherwise(F.col("doc_id"))
    more = [F.col("row").alias(row), F.when(F.col("known"), F.col("row") == F.col("least")).otherwise(True).alias("chosen")] if row else []
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), *more)


def _candidate_sets(src: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, items): full shingle sets of the wanted classes, each from one of its documents."""
    found = src.select(F.col("row").alias("of"), "text").join(broadcast_if_small(wanted), F.col("of") == F.col("row")).select("node", "text")
    return stage(found.mapInArrow(_set_maker(k), "node long, items array<long>"), "sets")


def _ends(df: DataFrame, end: str, col: str) -> DataFrame:
    return df.select(F.col("node").alias(end), F.col(col).alias(f"{col}_{end}"))


def _verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(a, b) whose full sets are similar enough; pairs with signatures that rule this out are left out first."""
    near = pairs.join(_ends(classes, "a", "marks"), "a").join(_ends(classes, "b", "marks"), "b")
    near = stage(near.where(_agreement("marks_a", "marks_b") >= percent / 100 - MARGIN).select("a", "b"), "near")
    return _similar(near, sets, percent)


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(a, b) whose full sets are similar enough, without a look at signatures."""
    both = pairs.join(_ends(sets, "b", "items"), "b").join(_ends(sets, "a", "items"), "a")
    common = F.size(F.array_intersect("items_a", "items_b"))
    return both.where(100 * common >= percent * (F.size("items_a") + F.size("items_b") - common)).select("a", "b")


def _mixed(buckets: DataFrame, parts: DataFrame, turn: int) -> DataFrame:
    """Members of the buckets that hold several components: (bucket, node, mine, top, hub).

    mine and top are struct(size, root) of the member's component and of the largest one in
    the bucket, and hub is a class of that one there, another in each turn.
    """
    sizes = stage(parts.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "sizes")
    mine = join_counted(parts, sizes, "root").select("node", F.struct("n", "root").alias("mine"))
    labelled = buckets.join(broadcast_if_small(stage(mine, "sized")), "node", "left")
    labelled = labelled.withColumn("mine", F.coalesce("mine", F.struct(F.lit(1).cast("long").alias("n"), F.col("node").alias("root"))))
    held = labelled.groupBy("bucket", "mine").agg(F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("hub"), F.count(F.lit(1)).alias("n"))
    held = held.groupBy("bucket").agg(
        F.max("mine").alias("top"), F.max_by("hub", "mine").alias("hub"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("components")
    )
    return join_counted(labelled, stage(held.where("components > 1"), "held"), "bucket").select("bucket", "node", "mine", "top", "hub")


def _search(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes of different components that can be similar enough, b being in the smaller one.

    Similar sets of n and m items share at least need = percent (n + m) / (100 + percent)
    of them. With the items of every set in one order, the rarest first, the first shared
    one has need - 1 shared ones behind it, so its place is at most n - need in the one set
    and m - need in the other. Every set is therefore listed under those of its items alone
    that can be the first one, for each size of the other set (in steps of SIZE_STEP), and
    sets that meet under an item are the pairs. Two sets that differ too much have no item
    in common there but their rarest ones, so near copies that fall short of the
    similarity are not listed against each other, however many there are.
    """
    nodes = stage(mixed.groupBy("node", "mine").agg(F.max(F.col("mine") < F.col("top")).alias("asks")), "nodes")
    held = stage(nodes.join(sets, "node").select("node", "asks", F.explode("items").alias("item")), "items")
    # an item of one class only, or of none that asks, starts no pair, but has its place in the order
    often = held.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.max("asks").alias("asked"))
    met = join_counted(held, stage(often, "often"), "item")
    ranked = met.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "item", "asked"))).alias("x")).join(nodes, "node")
    ranked = ranked.select("node", "mine", "asks", F.size("x").alias("size"), F.posexplode("x").alias("at", "x")).where("x.n > 1 AND x.asked")

    step = math.log(SIZE_STEP)
    size_class = lambda m: F.floor(F.log(m) / step)
    fewest, most = F.ceil(F.col("size") * percent / 100), F.floor(F.col("size") * 100 / percent)
    listed = ranked.withColumn("other", F.explode(F.sequence(size_class(fewest), size_class(most))))
    least = F.greatest(F.floor(F.exp(F.col("other") * step)) - 1, fewest)  # of the sizes in that class
    listed = listed.where((100 + percent) * (F.col("size") - F.col("at")) >= percent * (F.col("size") + least))
    listed = stage(listed.select("node", "mine", "asks", F.col("x.item").alias("item"), size_class(F.col("size")).alias("own"), "other"), "listed")
    q = listed.where("asks").select("item", F.col("own").alias("s"), F.col("other").alias("t"), F.col("node").alias("b"), F.col("mine").alias("less"))
    d = listed.select("item", F.col("other").alias("s"), F.col("own").alias("t"), F.col("node").alias("a"), F.col("mine").alias("more"))
    return q.join(d, ["item", "s", "t"]).where("less < more").select("a", "b").distinct()
