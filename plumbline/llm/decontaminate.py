"""Benchmark decontamination by winnowing (Schleimer, Wilkerson and Aiken 2003), in DataFrame operations only.

A text's fingerprints are the least k-gram hashes of all windows of w consecutive k-grams.
Texts that share w + k - 1 words share the fingerprint of that window, so with
w + k - 1 = SPAN every shared span of SPAN words leads to a hit, which is then extended
to the left and right on the words themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import ascii_lower, broadcast_if_small, let, stage

#: Words of a window, of a k-gram, and k-grams to choose a fingerprint from.
SPAN, GRAM = 10, 5
#: ASCII characters that are not 0-9 or a-z part words, after lower-casing A-Z.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS), "")


def _grams(hashes: Column, k: int, span: int) -> Column:
    """Hash of the k words from each position, marked with the span it serves; none if there are fewer."""

    def at(i: Column) -> Column:
        return F.xxhash64(F.lit(span), *(hashes[i + j] for j in range(k)))

    return F.when(F.size(hashes) >= k, F.transform(F.sequence(F.lit(0), F.size(hashes) - k), at)).otherwise(F.array().cast("array<bigint>"))


def _least(grams: Column, w: int) -> Column:
    """Distinct least hashes of all windows of w grams; none for fewer grams."""
    if w == 1:
        return F.array_distinct(grams)
    windows = F.transform(F.sequence(F.lit(0), F.size(grams) - w), lambda i: F.least(*(grams[i + j] for j in range(w))))
    return F.array_distinct(F.when(F.size(grams) >= w, windows).otherwise(F.array().cast("array<bigint>")))


def _by_span(words: Column, spans: list[tuple[int, int]], of) -> Column:
    """of(grams, k, span) for each (span, k), put together."""

    def one(h: Column, k: int, span: int) -> Column:
        return let(_grams(h, k, span), lambda g: of(g, k, span))

    def hashed(ws: Column) -> Column:
        return let(F.transform(ws, lambda x: F.xxhash64(x)), lambda h: F.concat(*(one(h, k, span) for span, k in spans)))

    return let(words, hashed)


def _fingerprints(words: Column, spans: list[tuple[int, int]]) -> Column:
    return _by_span(words, spans, lambda g, k, span: _least(g, span - k + 1))


def _places(words: Column, spans: list[tuple[int, int]], wanted: Column) -> Column:
    """Every occurrence of the wanted hashes, with the words around: as many as still fit into one span."""

    def found(ws: Column) -> Column:
        def of(g: Column, k: int, span: int) -> Column:
            far = span - k
            near = F.transform(
                F.filter(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("p"))), lambda s: F.array_contains(wanted, s["h"])),
                lambda s: F.struct(
                    s["h"].alias("h"),
                    s["p"].alias("p"),
                    F.lit(k).alias("k"),
                    F.lit(span).alias("span"),
                    F.reverse(F.slice(ws, F.greatest(s["p"] - far, F.lit(0)) + 1, F.least(s["p"], F.lit(far)))).alias("left"),
                    F.slice(ws, s["p"] + 1, F.lit(k)).alias("mid"),
                    F.slice(ws, s["p"] + k + 1, F.lit(far)).alias("right"),
                ),
            )
            return near

        return _by_span(ws, spans, of)

    return let(words, found)


def _agreeing(a: Column, b: Column) -> Column:
    """In how many elements from the first on two arrays agree."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return let(same, lambda s: F.when(F.array_position(s, F.lit(False)) > 0, F.array_position(s, F.lit(False)) - 1).otherwise(F.size(s)).cast("int"))


def contamination(docs: DataFrame, benchmark: DataFrame, *carry: str) -> DataFrame:
    """How much of each document occurs in benchmark items, word by word.

    docs needs doc_id (long) and text, benchmark item_id and text; other columns are
    ignored, whatever their names. Returns one row per row of docs: doc_id, n_words, n_hit
    (words inside an occurrence of a window: SPAN consecutive words of an item, or all of
    an item that has fewer), n_items (distinct item_ids with such a window), items_sha256
    (hex digest of those ids, sorted as strings and joined by commas) and contaminated
    (n_hit > 0), and the carried columns of docs. A null, empty or blank text has no words; an item without words has no
    window; a null item_id hits but is not listed; repeated rows and ids are each answered
    or joined. With an empty benchmark every document is clean; no documents, no rows.

    Fingerprints are joined with the benchmark's as they are exploded, without a shuffle
    while a count proves the benchmark small; texts are read again only for documents with
    a common fingerprint, one for each distinct text.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = stage(items, "items")
    short = [r.n for r in items.where(F.size("words") < SPAN).select(F.size("words").alias("n")).distinct().collect()]  # 9 values at most
    spans = [(SPAN, GRAM), *((n, n) for n in sorted(short))]
    none = F.array().cast("array<bigint>")
    whole = let(  # of an item of fewer words the gram of all its words
        F.transform("words", lambda x: F.xxhash64(x)), lambda h: F.concat(none, *(F.when(F.size(h) == n, _grams(h, n, n)).otherwise(none) for n in sorted(short)))
    )
    mine = F.when(F.size("words") >= SPAN, _fingerprints(F.col("words"), spans[:1])).otherwise(whole)
    marks = items.withColumn("wanted", mine)
    marks = marks.select("item_id", F.explode(_places(F.col("words"), spans, F.col("wanted"))).alias("i")).select("item_id", "i.*")
    marks = stage(marks.select("h", "k", "span", "left", "mid", "right", "item_id").distinct(), "marks")
    known = stage(marks.select("h").distinct(), "known")

    text = F.col("text")
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), *carry, F.xxhash64(text).alias("t1"), F.crc32(text).alias("t2"),
        let(words_of(text), lambda ws: F.struct(F.size(ws).cast("long").alias("n"), _fingerprints(ws, spans).alias("prints"))).alias("w"),
    )
    base = stage(base.select("doc_id", *carry, "t1", "t2", F.col("w.n").alias("n_words"), F.col("w.prints").alias("prints")), "prints")
    hits = base.select("doc_id", "t1", "t2", F.explode("prints").alias("h")).join(broadcast_if_small(known), "h")
    hits = hits.groupBy("t1", "t2").agg(F.min("doc_id").alias("rep"), F.collect_set("h").alias("wanted"))
    hits = stage(hits, "hits")

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("s1"), F.crc32(text).alias("s2"), text)
    again = src.join(broadcast_if_small(hits, 50_000), F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("s1") == F.col("t1")) & (F.col("s2") == F.col("t2")))
    place = again.select("t1", "t2", F.explode(_places(words_of(text), spans, F.col("wanted"))).alias("d"))
    m = broadcast_if_small(marks.select("h", *(F.col(c).alias(f"i_{c}") for c in ("left", "mid", "right")), "item_id"), 50_000)
    met = place.select("t1", "t2", "d.*").join(m, "h").where("mid = i_mid")
    met = met.select("t1", "t2", "item_id", "p", "k", "span", _agreeing(F.col("left"), F.col("i_left")).alias("a"), _agreeing(F.col("right"), F.col("i_right")).alias("b"))
    met = met.where("a + k + b >= span").select("t1", "t2", "item_id", F.struct((F.col("p") - F.col("a")).alias("s"), (F.col("p") + F.col("k") + F.col("b")).alias("e")).alias("run"))
    found = met.groupBy("t1", "t2").agg(F.collect_set("item_id").alias("ids"), F.collect_set("run").alias("runs"))
    covered = F.aggregate(
        F.array_sort("runs"),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, r: F.struct(
            F.greatest(acc["end"], r["e"]).alias("end"),
            (acc["n"] + F.greatest(r["e"] - F.greatest(acc["end"], r["s"]), F.lit(0))).cast("long").alias("n"),
        ),
    )["n"]
    found = found.select("t1", "t2", covered.alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("ids"), ","), 256).alias("digest"))
    found = stage(found, "found")
    out = base.select("doc_id", *carry, "n_words", "t1", "t2").join(broadcast_if_small(found), ["t1", "t2"], "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        *carry,
    )
