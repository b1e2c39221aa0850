"""Repeated passages by sparse suffix arrays.

Only suffixes that begin at minimisers are kept: positions whose GRAM-word hash is least
among WINDOW in a row, chosen by content alone, so equal passages choose equal places.
Every SPAN-word passage has one within its first WINDOW words, and at least HEAD words of
the passage follow it. The suffixes of all documents are sorted by the hash of their first
HEAD words over all tasks and compared with their neighbours; those with an equal
neighbour are extended to the left and right: every SPAN-word passage around them is
compared again, and those that another document has too are merged into maximal spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import small_batches, stage, unstage
from plumbline.llm.textkit import _BASE, _INVERSE, _power, chunks, mix, words_of

SPAN, GRAM, WINDOW = 50, 8, 32
HEAD = SPAN - WINDOW + 1
NO_ID = -(1 << 63)
_U = np.uint64
_MOST = np.iinfo(np.uint64).max


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    if len(words) < n:
        return np.empty(0, dtype=np.uint64)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * _power(_BASE, len(words)), out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * _power(_INVERSE, len(words) + 1)[: len(words) - n + 1] + _U(n))


def _sliding(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Minimum or maximum of every w neighbours, in a number of steps that does not grow with w."""
    fold = np.minimum if least else np.maximum
    n = len(x) - w + 1
    padded = np.concatenate([x, np.full(-len(x) % w, _MOST if least else 0, dtype=x.dtype)]).reshape(-1, w)
    before = fold.accumulate(padded, axis=1).ravel()
    after = fold.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return fold(after[:n], before[w - 1 : w - 1 + n])


def minimisers(words: np.ndarray) -> np.ndarray:
    """Positions whose gram is least in some window of WINDOW grams; none in texts shorter than SPAN words."""
    if len(words) < SPAN:
        return np.empty(0, dtype=np.int64)
    g = window_hashes(words, GRAM)
    low = _sliding(g, WINDOW, True)
    edge = np.zeros(WINDOW - 1, dtype=np.uint64)
    return np.flatnonzero(_sliding(np.concatenate([edge, low, edge]), WINDOW, False) == g)


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(head, doc_id, t1, at) of the kept suffixes with at least HEAD words."""
    for batch in batches:
        ids, marks, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
        for a, b in chunks(texts):
            words, bounds = words_of(texts[a:b])
            heads, doc, places = [], [], []
            for i, (x, y) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                at = minimisers(words[x:y])
                at = at[at <= y - x - HEAD]
                if len(at):
                    heads.append(window_hashes(words[x:y], HEAD)[at])
                    doc.append(np.full(len(at), a + i))
                    places.append(at)
            if heads:
                where = pa.array(np.concatenate(doc))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(heads).view(np.int64)), ids.take(where), marks.take(where), pa.array(np.concatenate(places).astype(np.int32))],
                    names=["head", "doc_id", "t1", "at"],
                )


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one task's sorted suffixes those with an equal neighbour, and the first and last one in any case (edge)."""
    held, edge, before = None, True, None
    for batch in batches:
        if batch.num_rows:
            table = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if table.num_rows > 1:
                out, before, edge = _compared(table, before, edge, False)
                if out.num_rows:
                    yield out
            held = table.slice(table.num_rows - 1)
    if held is not None:
        out, _, _ = _compared(held, before, edge, True)
        yield out


def _compared(table: pa.RecordBatch, before: int | None, edge: bool, last: bool) -> tuple[pa.RecordBatch, int | None, bool]:
    """All rows but the last, or with last all rows, against their neighbours."""
    head = table.column(0).to_numpy()
    n = len(head) if last else len(head) - 1
    same = np.zeros(n, dtype=bool)
    same[: len(head) - 1] |= head[1:] == head[:-1]
    same[1:] |= head[1:n] == head[: n - 1]
    if before is not None:
        same[0] |= head[0] == before
    edges = np.zeros(n, dtype=bool)
    edges[0] = edge
    edges[-1] |= last
    keep = np.flatnonzero(same | edges)
    out = table.slice(0, n).take(pa.array(keep))
    return pa.RecordBatch.from_arrays([*out.columns, pa.array(same[keep]), pa.array(edges[keep])], names=["head", "doc_id", "t1", "at", "same", "edge"]), int(head[n - 1]), False


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(passage, doc_id, node, begin) of all SPAN-word passages that have a candidate suffix within their first WINDOW words."""
    for batch in batches:
        ids, nodes, texts, places = batch.column(0), batch.column(1), batch.column(2).to_pylist(), batch.column(3)
        for a, b in chunks(texts):
            words, bounds = words_of(texts[a:b])
            found, doc, begins = [], [], []
            for i, (x, y) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                all_of = window_hashes(words[x:y], SPAN)
                at = places[a + i].values.to_numpy()
                edge = np.zeros(y - x + 2, dtype=np.int32)
                np.add.at(edge, np.maximum(at - WINDOW + 1, 0), 1)
                np.add.at(edge, at + 1, -1)
                begin = np.flatnonzero(np.cumsum(edge)[: len(all_of)] > 0)
                found.append(all_of[begin])
                doc.append(np.full(len(begin), a + i))
                begins.append(begin)
            where = pa.array(np.concatenate(doc))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(found).view(np.int64)), ids.take(where), nodes.take(where), pa.array(np.concatenate(begins).astype(np.int32))],
                names=["passage", "doc_id", "node", "begin"],
            )


def candidates(docs: DataFrame) -> DataFrame:
    """Sort the kept suffixes of docs(doc_id, t1, text); a staged row (node, c_id, c_t1, at) for each document that has some with an equal neighbour."""
    spark = docs.sparkSession
    kept = stage(docs.mapInArrow(_suffixes, "head long, doc_id long, t1 long, at int"), "suffixes")
    keys = ["head", "doc_id", "t1", "at"]  # the last three spread a very common head over several tasks
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = kept.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    near = stage(ordered.mapInArrow(_neighbours, "head long, doc_id long, t1 long, at int, same boolean, edge boolean"), "neighbours")
    # heads that meet only across two tasks: two edge rows for each task at most
    edges = near.where("edge").groupBy("head").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("head")
    across = near.where("edge AND NOT same").join(F.broadcast(edges), "head", "left_semi")
    found = near.where("same").unionByName(across).groupBy(F.col("doc_id").alias("c_id"), F.col("t1").alias("c_t1")).agg(F.collect_set("at").alias("at"))
    # a document's own list of places is bounded by its length; node numbers hold from here on
    found = stage(found.select(F.monotonically_increasing_id().alias("node"), "c_id", "c_t1", "at"), "candidates")
    unstage(kept, near)
    return found


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Maximal spans of words whose every SPAN-word passage also occurs in another document.

    docs needs doc_id (long) and text; other columns are ignored, whatever their names.
    Words are lower-cased (A-Z) runs without white space over the whole text. Returns a
    row for each span: doc_id, begin and end (word offsets, end exclusive), n_words and
    first_doc_id (the least doc_id with a passage of the span, which may be the row's own).
    Documents without such a span have no row. A null doc_id counts as the least long
    (NO_ID) when documents are told apart and is null again in the result; null, empty and short texts have no spans;
    repeated rows (equal id and text) count as one document, and so do repeats inside one
    document. An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    src = docs.select(key.alias("doc_id"), F.xxhash64("text").alias("t1"), F.col("text"))
    found = candidates(src)
    again = src.join(found, (F.col("doc_id") == F.col("c_id")) & (F.col("t1") == F.col("c_t1")))
    passages = stage(again.select("doc_id", "node", "text", "at").mapInArrow(_passages, "passage long, doc_id long, node long, begin int"), "passages")
    shared = passages.groupBy("passage").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high").select("passage", "low")
    hits = passages.select("passage", "node", "begin").join(shared, "passage").groupBy("node").agg(F.array_sort(F.collect_set(F.struct("begin", "low"))).alias("x"))
    merged = F.aggregate(
        "x",
        F.array().cast("array<struct<begin:int,end:int,low:bigint>>"),
        lambda acc, e: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= e["begin"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["begin"].alias("begin"), (e["begin"] + SPAN).alias("end"), F.least(F.element_at(acc, -1)["low"], e["low"]).alias("low"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(e["begin"].alias("begin"), (e["begin"] + SPAN).alias("end"), e["low"].alias("low"))))),
    )
    hits = hits.join(found.select("node", F.col("c_id").alias("doc_id")), "node")
    spans = hits.select("doc_id", F.explode(merged).alias("s")).select("doc_id", "s.*")
    doc, first = (F.nullif(F.col(c), F.lit(NO_ID)) for c in ("doc_id", "low"))
    return spans.select(doc.alias("doc_id"), "begin", "end", (F.col("end") - F.col("begin")).alias("n_words"), first.alias("first_doc_id"))
