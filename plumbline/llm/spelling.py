"""Spelling variants: dense tiles of padded code-point matrices find all words one edit apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import ascii_lower, join_counted, small_batches, stage
from plumbline.llm.merkle import CRC32_SQL

#: Maximal runs of these are words.
RUN = r"[A-Za-zÀ-ÿ]+"
#: Words of a block, and the length up to which it has that many; a block of longer words has fewer.
BLOCK, WIDTH = 256, 64
#: Cells that are compared at once.
CELLS = 1 << 21


def dented(doc_id: Column, word: Column, every: int = 199) -> Column:
    """word without its code point at h % length, where `every` divides h, the CRC-32 of `<doc_id>:<word>`."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), word))
    at = (h % F.char_length(word)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))).otherwise(word)


def count_words(docs: DataFrame, least_length: int = 6, least_count: int = 5, every: int = 199) -> DataFrame:
    """(word, n): words of the texts with at least so many code points and occurrences, some of them dented.

    docs needs doc_id and text. Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, of
    which A-Z are lower-cased; null texts have none, and of a null doc_id no word is dented.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    words = runs.select("doc_id", ascii_lower(F.col("run")).alias("word"))
    words = words.select(F.coalesce(dented(F.col("doc_id"), F.col("word"), every), "word").alias("word"))
    return words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _tiles(words: DataFrame) -> DataFrame:
    """(suffix, longer, left, right): blocks of words to be compared, right being null where left is compared with itself.

    Of two words one edit apart, the longer of length L, the common prefix and the common
    suffix have L - 1 code points together, so one of them has L // 2 at least. Words
    are therefore grouped by the first and by the last L // 2 code points, once as the longer
    and once as the shorter word, and a group is dealt into blocks by a hash of the word.
    """
    size = F.char_length("word")
    keyed = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("longer"), F.explode(F.array(F.lit(False), F.lit(True))).alias("suffix"))
    half = F.floor(F.col("longer") / 2).cast("int")
    part = F.when(F.col("suffix"), F.substring("word", -half, half)).otherwise(F.substring("word", F.lit(1), half))
    keyed = keyed.withColumn("key", F.concat_ws("|", "suffix", "longer", part))
    # a group without a word of the longer length has no pair
    sized = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.max(size == F.col("longer")).alias("some"))
    sized = stage(sized.where("held > 1 AND some"), "sized")
    blocks = F.ceil(F.col("held") * F.greatest("longer", F.lit(WIDTH)) / (BLOCK * WIDTH))
    dealt = join_counted(keyed, sized, "key", "held").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("word"), "blocks"))
    block = stage(dealt.groupBy("key", "suffix", "longer", "blocks", "block").agg(F.collect_list(F.struct("word", "n")).alias("words")), "blocks")
    own = block.select("suffix", "longer", F.col("words").alias("left"), F.lit(None).cast(block.schema["words"].dataType).alias("right"))
    asks = block.where("block > 0").select("key", "suffix", "longer", F.col("words").alias("left"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("block") - 1)).alias("block"))
    pairs = asks.join(block.where("blocks > 1").select("key", "block", F.col("words").alias("right")), ["key", "block"])
    return own.unionByName(pairs.select("suffix", "longer", "left", "right"))


def _matrix(codes: np.ndarray, sizes: np.ndarray, width: int, right: bool) -> np.ndarray:
    """Words as rows of code points, padded with zeros behind or in front."""
    places = np.arange(width)
    held = places >= width - sizes[:, None] if right else places < sizes[:, None]
    out = np.zeros((len(sizes), width), dtype=np.uint8)
    out[held] = codes
    return out


def _edits(words: pa.Array, a: np.ndarray, b: np.ndarray, longer: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Which pairs (a, b) of words are one edit apart and belong to their tile; longer and suffix are those of each pair's tile."""
    text = words.to_pylist()
    sizes = np.fromiter(map(len, text), np.int64, len(text))
    codes = np.frombuffer("".join(text).encode("latin-1"), np.uint8)
    width = int(sizes.max())
    front, back = _matrix(codes, sizes, width, False), _matrix(codes, sizes, width, True)[:, ::-1]
    keep = np.flatnonzero(np.maximum(sizes[a], sizes[b]) == longer)
    found = [np.empty(0, dtype=np.int64)]
    step = max(1, CELLS // width)
    for at in range(0, len(keep), step):
        these = keep[at : at + step]
        x, y, most = a[these], b[these], longer[these]
        prefix = np.argmax(front[x] != front[y], axis=1)
        rest = np.argmax(back[x] != back[y], axis=1)
        # a pair that shares both halves is found under its prefix alone
        found.append(these[(prefix + rest >= most - 1) & (~suffix[these] | (prefix < most // 2))])
    return np.concatenate(found)


def _runs(words: np.ndarray, pairs: np.ndarray, longer: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of tiles whose matrices and pairs stay within CELLS; a larger tile stands alone."""
    begin, held, listed, width = 0, 0, 0, 0
    for i, (w, p, most) in enumerate(zip(words.tolist(), pairs.tolist(), longer.tolist(), strict=True)):
        if i > begin and ((held + w) * max(width, most) > CELLS or listed + p > CELLS):
            yield begin, i
            begin, held, listed, width = i, 0, 0, 0
        held, listed, width = held + w, listed + p, max(width, most)
    if begin < len(words):
        yield begin, len(words)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        suffix, longer = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(2))
        left, right = batch.column(2), batch.column(3)
        own = np.asarray(right.is_null())
        n, m = (np.asarray(x.value_lengths().fill_null(0)).astype(np.int64) for x in (left, right))
        at, to = (np.concatenate([[0], np.cumsum(x)]) for x in (n, m))
        pairs = np.where(own, n * (n - 1) // 2, n * m)
        for i, j in _runs(n + m, pairs, longer):
            held = pa.concat_arrays([left.flatten().slice(at[i], at[j] - at[i]), right.flatten().slice(to[i], to[j] - to[i])])
            a, b = [], []
            for t in range(i, j):
                x, y = np.triu_indices(n[t], 1) if own[t] else np.divmod(np.arange(n[t] * m[t]), m[t])
                a.append(x + (at[t] - at[i]))
                b.append(y + (at[t] - at[i] if own[t] else at[j] - at[i] + to[t] - to[i]))
            a, b = np.concatenate(a), np.concatenate(b)
            tile = np.repeat(np.arange(i, j), pairs[i:j])
            words, counts = held.field("word"), held.field("n")
            hit = _edits(words, a, b, longer[tile], suffix[tile])
            x, y = pa.array(a[hit]), pa.array(b[hit])
            yield pa.RecordBatch.from_arrays([words.take(x), counts.take(x), words.take(y), counts.take(y)], names=["a", "n_a", "b", "n_b"])


def near_words(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): each pair of words(word, n) that one inserted, deleted or replaced code point tells apart, once.

    Words are of code points up to U+00FF, each in one row.
    """
    small_batches(words.sparkSession)
    return _tiles(words).mapInArrow(_compared, "a string, n_a long, b string, n_b long")


def group_variants(words: DataFrame, times: int = 5) -> DataFrame:
    """The form of each of words(word, n): its commonest near word, if that is so many times as common.

    Returns word, form (null: none; ties go to the smallest in code-point order), root (from
    the word along the forms to the last; the word itself without a form), n, n_near (near
    words) and form_n. Each form is rarer than the next, so chains end; pointers are doubled
    in each round, and each round is staged. An empty table gives an empty one.
    """
    pairs = stage(near_words(words), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    enough = -F.col("best.less") >= times * F.col("n")
    formed = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")
    )
    formed = stage(formed, "formed")
    # (word, root) of the words with a form; a word that is not there is its own root
    roots = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        more = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stage(roots.join(more, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = moved.select("word", "root")
        if not moved.where("moved").take(1):
            break
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Words of docs (see count_words) with their forms and roots (see group_variants).

    Other columns are ignored, whatever their names; repeated rows and ids count each time.
    """
    words = stage(count_words(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "words")
    return group_variants(words)


_CRC = CRC32_SQL.format(bytes="list_transform(string_split(regexp_replace(hex(encode(doc_id::VARCHAR || ':' || run)), '(..)', '\\1 ', 'g').trim(), ' '), lambda x: ('0x' || x)::INT)")
ORACLE_SQL = rf"""WITH runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
hashed AS (SELECT run, k, {_CRC} AS h FROM (SELECT doc_id, run, count(*) AS k FROM runs GROUP BY doc_id, run)),
dented AS (SELECT k, CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM hashed),
words AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM dented WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
cut AS MATERIALIZED (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT DISTINCT a.word AS a, b.word AS b, b.n AS n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT DISTINCT cut.word, words.word, words.n FROM cut JOIN words ON cut.rest = words.word
  UNION SELECT DISTINCT words.word, cut.word, cut.n FROM cut JOIN words ON cut.rest = words.word),
best AS (SELECT a, count(*) AS n_near, min(struct_pack(less := -n, near := b)) AS m FROM pairs GROUP BY a),
formed AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -m.less >= 5 * n THEN m.near END AS form,
  CASE WHEN -m.less >= 5 * n THEN -m.less END AS form_n FROM words LEFT JOIN best ON a = word),
"""
ORACLE_SQL = ORACLE_SQL.replace("WITH runs", "WITH RECURSIVE runs", 1) + """chain AS (SELECT word, word AS root FROM formed
  UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT word, form, c.root, n, n_near, form_n FROM formed JOIN (SELECT c.word, c.root FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NULL) c USING (word)"""
