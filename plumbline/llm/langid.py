"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of order 0 to 3 with frozen counts. A symbol's
probability under a context with total count T and D distinct symbols is c / (T + D) if
it was seen there; all others share the escape mass D / (T + D) in proportion to their
probabilities under the next shorter context; below order 0 all 256 bytes are equally
likely. A text's code length under a language is the sum of -ln p over all its bytes
(A-Z lower-cased, preceded by three newlines); the shortest code wins.

Only what was seen is kept: sorted tables of the strings of one to four bytes of each
language with their code lengths, and of its contexts with the price of an escape. A batch
of texts is reduced to its distinct strings of four bytes, which are looked up for each
language, longest context first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from plumbline.llm.common import small_batches
from plumbline.llm.textkit import chunks

ORDER = 3
#: The model is fitted on at most so many labelled documents of each language (those with
#: the smallest hashes, whole), none of more than SAMPLE_BYTES bytes, and on the LANGUAGES
#: values of lang with most documents.
SAMPLE_DOCS, SAMPLE_BYTES, LANGUAGES = 400, 200_000, 1_000
_PAD = b"\n" * ORDER
_BLOCK = 1 << 20


@dataclass
class Level:
    """One order of one language: nats of each string seen, and of an escape from each context."""

    grams: np.ndarray  # sorted; context and symbol, big-endian
    nats: np.ndarray
    contexts: np.ndarray  # sorted
    escapes: np.ndarray


@dataclass
class LanguageModel:
    """Frozen statistics: the levels of each language by order."""

    languages: list[str]
    levels: list[list[Level]]

    def nats(self, grams: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each string of ORDER + 1 bytes after the others, by language."""
        out = np.zeros((len(grams), len(self.languages)))
        for i, levels in enumerate(self.levels):
            left = np.arange(len(grams))  # what no longer context has seen
            for order in range(ORDER, -1, -1):
                level, g = levels[order], grams[left] & np.uint32((1 << 8 * (order + 1)) - 1)
                at, seen = _find(level.grams, g)
                out[left[seen], i] += level.nats[at[seen]]
                left, g = left[~seen], g[~seen]
                at, seen = _find(level.contexts, g >> np.uint32(8))
                out[left[seen], i] += level.escapes[at[seen]]
            out[left, i] += np.log(256)
        return out

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Nats of each whole text under each language."""
        raw = [_PAD + t.encode("utf-8", "surrogatepass").lower() for t in texts]
        ends = np.cumsum([len(r) for r in raw])
        blob = np.frombuffer(b"".join(raw), dtype=np.uint8)
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        pads = (begins[:, None] + np.arange(ORDER)).ravel()  # are context only, not coded
        out = np.zeros((len(texts), len(self.languages)))
        for at in range(0, len(blob), _BLOCK):
            to = min(len(blob), at + _BLOCK)
            c = np.concatenate([np.zeros(max(0, ORDER - at), dtype=np.uint8), blob[max(0, at - ORDER) : to]])
            grams, where = np.unique(_strings(c), return_inverse=True)
            nats = self.nats(grams)
            first, last = np.searchsorted(ends, at, side="right"), np.searchsorted(ends, to)
            starts = np.concatenate([[at], ends[first:last]]) - at
            skipped = pads[np.searchsorted(pads, at) : np.searchsorted(pads, to)] - at
            for i in range(len(self.languages)):
                code = nats[where, i]
                code[skipped] = 0
                out[first : last + 1, i] += np.add.reduceat(code, starts)
        return out


def _strings(b: np.ndarray) -> np.ndarray:
    """All runs of ORDER + 1 bytes as numbers."""
    b = b.astype(np.uint32)
    return (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted table, and which of them are there."""
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, table[at] == keys if len(table) else np.zeros(len(keys), dtype=bool)


def build(counts: dict[str, dict[bytes, int]]) -> LanguageModel | None:
    """The model for counts of byte strings of ORDER + 1 bytes (context and symbol) by language."""
    if not any(counts.values()):
        return None
    languages = sorted(counts)
    return LanguageModel(languages, [_levels(counts[lang]) for lang in languages])


def _levels(counts: dict[bytes, int]) -> list[Level]:
    keys = np.frombuffer(b"".join(counts), dtype=">u4").astype(np.uint32)
    n = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
    levels: list[Level] = []
    for order in range(ORDER + 1):
        grams, back = np.unique(keys & np.uint32((1 << 8 * (order + 1)) - 1), return_inverse=True)
        held = np.bincount(back, weights=n, minlength=len(grams))
        contexts, of = np.unique(grams >> np.uint32(8), return_inverse=True)
        total, distinct = np.bincount(of, weights=held, minlength=len(contexts)), np.bincount(of, minlength=len(contexts))
        if order:  # a string was seen after every shorter context if it was after the longer one
            shorter = levels[-1].nats[np.searchsorted(levels[-1].grams, grams & np.uint32((1 << 8 * order) - 1))]
        else:
            shorter = np.full(len(grams), np.log(256))
        spare = 1 - np.bincount(of, weights=np.exp(-shorter), minlength=len(contexts))  # of the symbols not seen here
        with np.errstate(divide="ignore", invalid="ignore"):
            escapes = np.where(distinct < 256, np.log(spare) - np.log(distinct / (total + distinct)), 0)
            nats = -np.log(held / (total + distinct)[of])
        levels.append(Level(grams, nats, contexts, escapes))
    return levels


def is_held_out(doc_id: Column) -> Column:
    """The fold that is never learned from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(labelled: DataFrame, docs_each: int = SAMPLE_DOCS) -> LanguageModel | None:
    """Fit on labelled(key, text, lang): a bounded sample of each language's rows.

    Rows with a null key, text or lang, empty texts and texts over SAMPLE_BYTES are not
    learned from; rows with equal key and text count once. The sample is thinned by a hash
    before it is ranked, so no language's rows meet in one task. Of more than LANGUAGES
    values of lang those with fewest documents are not learned. None if nothing is left.
    """
    rows = labelled.select(F.col("key").cast("string").alias("key"), "text", F.col("lang").cast("string").alias("lang")).where(
        (F.octet_length("text") > 0) & (F.octet_length("text") <= SAMPLE_BYTES) & F.col("key").isNotNull() & F.col("lang").isNotNull()
    )
    rows = rows.select("lang", "text", F.shiftright(F.xxhash64("key", "text"), 2).alias("h"))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    share = F.least(F.lit(1.0), F.lit(3.0 * docs_each) / F.col("n"))
    rate = sizes.select("lang", ((share * 2.0 - 1.0) * float(1 << 61)).alias("below"))
    rows = rows.join(F.broadcast(rate), "lang").where("h <= below")  # LANGUAGES rows at most
    rows = rows.groupBy("lang", "h").agg(F.first("text").alias("text"))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("h")))
    grams = rows.where(F.col("rank") <= docs_each).select("lang", "text").mapInArrow(_grams, "lang string, gram int, n long")
    counts: dict[str, dict[bytes, int]] = {}
    for lang, gram, n in grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow().to_pandas().itertuples(index=False):
        counts.setdefault(lang, {})[int(gram & 0xFFFFFFFF).to_bytes(4, "big")] = int(n)
    return build(counts) if counts else None


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of byte strings of ORDER + 1 bytes by language in each batch."""
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        texts = batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            found = []
            for t in (texts[i] for i in np.flatnonzero(langs == lang)):
                found.append(_strings(np.frombuffer(_PAD + t.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)))
            gram, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int32)), pa.array(n, pa.int64())], names=["lang", "gram", "n"]
            )


def identify(docs: DataFrame, model: LanguageModel | None, *carry: str) -> DataFrame:
    """Predict the language of every row's whole text.

    Returns the carried columns of docs and lang_pred (a language of the model; 'und' if
    the text is null, has no letter, or there is no model), score (the posterior of
    lang_pred under equal priors, 0 for 'und') and bits_per_byte (its code length by
    UTF-8 byte; null for 'und'). Rows are neither dropped nor merged; an empty table gives
    an empty one; other columns of docs are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(*carry, F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("_text"))
    schema = T.StructType(
        [*rows.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())]
    )
    if model is None:
        return rows.select(*carry, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    shared = spark.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(len(carry)).to_pylist()
            for a, b in chunks(texts):
                part = texts[a:b]
                some = [i for i, t in enumerate(part) if t]
                pred, score, bits = ["und"] * len(part), np.zeros(len(part)), [None] * len(part)
                if some:
                    nats = m.code_lengths([part[i] for i in some])
                    best = nats.argmin(axis=1)
                    least = nats.min(axis=1)
                    score[some] = 1 / np.exp(least[:, None] - nats).sum(axis=1)
                    for i, k, x in zip(some, best, least, strict=True):
                        pred[i], bits[i] = m.languages[k], float(x / np.log(2) / len(part[i].encode("utf-8", "surrogatepass")))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(a, b - a) for c in range(len(carry))), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())],
                    names=schema.names,
                )

    return rows.mapInArrow(scored, schema)
