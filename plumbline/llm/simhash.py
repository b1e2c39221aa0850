"""Near-duplicate groups by SimHash: deletion variants of segments find all fingerprints a few bits apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import join_counted, small_batches, stage
from plumbline.llm.components import connected_components

#: Bits of a fingerprint, and the seed of the shingles' XXH64.
BITS, SEED = 64, 42
#: Rounds in which members of a bucket are verified against some of it alone, the smallest and so many others.
HUB_ROUNDS, HUBS = 2, 2
#: Shingles whose bits are summed at once.
_BLOCK = 1 << 17


def fingerprint(text: str | None, k: int) -> int:
    """The SimHash of a text's k-word shingles, unsigned; 0 without a word.

    Words are runs without white space (\\x20, \\x09-\\x0D), A-Z lower-cased; a shingle is k
    words joined by spaces and counts as often as it occurs; fewer words are one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    k = min(k, len(words))
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends, digest = (ends - sizes)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), xxhash.xxh64_intdigest
    held = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(starts), _BLOCK):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at : at + _BLOCK], ends[at : at + _BLOCK], strict=True)], dtype=">u8")
        held += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * held > len(starts)).tobytes(), "big")


def _signer(k: int):
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), k) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "print"])

    return signed


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, width) of distance // 2 + 1 segments: of so many, one differs by at most one bit."""
    n = distance // 2 + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _rests(distance: int) -> list[int]:
    """For each bit the mask of its segment without the bit."""
    return [_signed(((1 << width) - 1) << first & ~(1 << at)) for first, width in segments(distance) for at in range(first, first + width)]


def _variants(prints: DataFrame, distance: int) -> DataFrame:
    """prints with a row for each bit: key, which names the bit and holds the rest of the bit's segment.

    Two fingerprints have a key in common if and only if a segment differs by one bit at most.
    """
    rests = F.array(*map(F.lit, _rests(distance)))
    rows = prints.select("*", F.posexplode(rests).alias("bit", "rest"))
    return rows.select(*prints.columns, "bit", F.xxhash64("bit", F.col("print").bitwiseAND(F.col("rest"))).alias("key"))


def _linked(a: Column, b: Column, bit: Column, distance: int) -> Column:
    """Whether two fingerprints are close enough, and bit is the first under which they meet, so that a link is found once."""
    differ = a.bitwiseXOR(b)
    here = F.lit(False)
    for start, width in reversed(segments(distance)):
        part = differ.bitwiseAND(F.lit(_signed(((1 << width) - 1) << start)))
        # the one bit that differs, or else the segment's first bit
        place = F.when(part == 0, bit == start).otherwise(part == F.call_function("shiftleft", F.lit(1).cast("long"), bit))
        here = F.when(F.bit_count(part) <= 1, place).otherwise(here)
    return (F.bit_count(differ) <= distance) & here


def _bucketed(prints: DataFrame, distance: int, turn: int) -> DataFrame:
    """A row for each key of prints(print, root): key, bit, print, root, low and high (the bucket's least and largest root) and hubs.

    hubs are some members of the bucket, each with its root: the smallest one, and HUBS others, other ones in each bucket and turn.
    """
    bucket = W.partitionBy("key")
    drawn = [F.min(F.struct(F.xxhash64("print", "key", F.lit(turn * HUBS + i)), "print", "root")).over(bucket) for i in range(HUBS)]
    hubs = [F.min(F.struct("print", "root")).over(bucket), *(F.struct(d["print"].alias("print"), d["root"].alias("root")) for d in drawn)]
    return _variants(prints, distance).select(
        "key", "bit", "print", "root", F.min("root").over(bucket).alias("low"), F.max("root").over(bucket).alias("high"), F.array(*hubs).alias("hubs")
    )


def roots(prints: DataFrame, distance: int) -> DataFrame:
    """(print, root) of distinct prints(print): the smallest fingerprint reached by links of at most distance differing bits.

    A bucket holds the fingerprints with one key. In HUB_ROUNDS rounds all members of a bucket
    that holds several components are verified against a few of its members, and linked
    to the smallest and the largest of those that are close. At last the members of buckets that
    still hold several components are verified against all members of other components, in
    the condition of the equijoin on the key. So every link between components is found, and
    a family of very many fingerprints close to each other is not listed pair by pair.
    """
    rooted = prints.select("print", F.col("print").alias("root"))
    for turn in range(HUB_ROUNDS + 1):
        mixed = _bucketed(rooted, distance, turn).where("low < high")
        if turn < HUB_ROUNDS:
            close = F.filter("hubs", lambda h: (h["root"] != F.col("root")) & (F.bit_count(F.col("print").bitwiseXOR(h["print"])) <= distance))
            close = mixed.select("root", F.transform(close, lambda h: h["root"]).alias("to")).where("size(to) > 0")
            ends = close.groupBy("root").agg(F.min(F.array_min("to")).alias("low"), F.max(F.array_max("to")).alias("high"))
            links = ends.select(F.col("root").alias("a"), F.explode(F.array("low", "high")).alias("b"))
        else:
            a = mixed.select("key", "bit", F.col("print").alias("a"), F.col("root").alias("root_a"))
            b = mixed.select("key", F.col("print").alias("b"), F.col("root").alias("root_b"))
            met = a.join(b, "key").where((F.col("root_a") > F.col("root_b")) & _linked(F.col("a"), F.col("b"), F.col("bit"), distance))
            links = met.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
        links = stage(links.distinct(), "links")
        if links.take(1):
            parts = stage(connected_components(links), "parts")
            old = rooted.withColumnRenamed("root", "node")
            rooted = stage(old.join(parts, "node", "left").select("print", F.coalesce("root", "node").alias("root")), "rooted")
    return rooted


def near_duplicates(docs: DataFrame, k: int = 5, distance: int = 4) -> DataFrame:
    """Group documents whose SimHash fingerprints differ in distance bits or fewer.

    docs needs doc_id (long) and text; other columns are ignored, whatever their names.
    Returns one row per row of docs: doc_id, fingerprint (16 hex digits) and component_id
    (smallest doc_id of the group, by links of any length). A null, empty or blank text has
    the fingerprint zero, which links like any other. Repeated rows and equal fingerprints
    share a component. A null doc_id takes part but is never the smallest, unless the whole
    group has none. An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stage(src.mapInArrow(_signer(k), "doc_id long, print long"), "printed")
    prints = stage(signed.groupBy("print").agg(F.min("doc_id").alias("low_id"), F.count(F.lit(1)).alias("copies")), "prints")
    lows = stage(prints.join(roots(prints.select("print"), distance), "print"), "lows")
    least = stage(lows.groupBy("root").agg(F.min("low_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "least")
    known = stage(join_counted(lows, least, "root").select("print", "copies", "component_id"), "known")
    out = join_counted(signed, known, "print", "copies")
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
