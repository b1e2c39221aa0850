"""Boilerplate lines by site-relative frequency, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import broadcast_if_small, stage

#: A line on more than RATIO of a host's pages is boilerplate, if the host has at least
#: LEAST_PAGES pages: below that, a share says nothing about a site.
RATIO, LEAST_PAGES = 0.2, 5

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
#: What turns HTML into lines, in order: dropped whole, line breaks, other marks, blanks.
_STEPS = [
    (r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)\s*>|<!--.*?-->", ""),
    (r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|td|th|article|section|header|footer|nav|main|aside|title|head|body|html|blockquote|pre|form|hr)(?:\s[^>]*)?/?>", "\n"),
    (r"<[^>]*>", ""),
    (r"[\x09\x0B-\x0D\x20]+", " "),
]
#: Character references that are resolved; the ampersand comes last.
_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; empty for null or none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1))


def lines_of(html: Column) -> Column:
    """Text lines of a page, trimmed, without blank ones."""
    out = F.coalesce(html, F.lit(""))
    for pattern, to in _STEPS:
        out = F.regexp_replace(out, pattern, to)
    for name, to in _ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(to))
    return F.array_remove(F.transform(F.split(out, "\n"), lambda x: F.trim(x)), "")


def drop_boilerplate(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """Drop the lines that more than ratio of a host's pages contain.

    pages needs page_id (long), url and html; other columns are ignored, whatever their
    names. Returns one row per row of pages: page_id, host, n_lines, n_dropped and text
    (the kept lines, joined by line feeds). A page counts once for a line however often it
    holds it, and loses all copies of a dropped one. Pages without a host (a null or broken
    url) are one site under ''. A null or empty html has no lines; repeated rows are pages
    of their own; hosts with fewer than least_pages pages lose nothing. An empty table
    gives an empty one.

    Counts are combined before they are shuffled; what is joined back is a host's list of
    dropped lines, which has at most (lines per page) / ratio entries.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), lines_of(F.col("html")).alias("lines"))
    rows = stage(rows, "lines")
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= least_pages)
    line = rows.select("host", F.explode(F.array_distinct("lines")).alias("line"))
    seen = line.groupBy("host", F.xxhash64("line").alias("h1"), F.crc32("line").alias("h2")).agg(F.count(F.lit(1)).alias("n"))
    often = seen.where(F.col("n") >= least_pages * ratio).join(hosts, "host").where(F.col("n") > F.col("pages") * ratio)
    often = often.groupBy("host").agg(F.collect_list(F.struct("h1", "h2")).alias("dropped"))
    out = rows.join(broadcast_if_small(stage(often, "boilerplate"), 50_000), "host", "left")
    none = F.array().cast("array<struct<h1:bigint,h2:bigint>>")
    kept = F.filter("lines", lambda x: ~F.array_contains(F.coalesce("dropped", none), F.struct(F.xxhash64(x).alias("h1"), F.crc32(x).alias("h2"))))
    out = out.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(kept).alias("kept"))
    return out.select("page_id", "host", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


def _sql_lines() -> str:
    out = "coalesce(html, '')"
    for pattern, to in _STEPS:
        to = "chr(10)" if to == "\n" else f"'{to}'"
        out = f"regexp_replace({out}, '{pattern}', {to}, 'g')"
    for name, to in _ENTITIES:
        to = to.replace("'", "''")
        out = f"replace({out}, '{name}', '{to}')"
    return f"list_filter(list_transform(string_split({out}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')"


ORACLE_SQL = f"""
WITH p AS (
  SELECT row_number() OVER () AS row_id, page_id, lower(regexp_extract(coalesce(url, ''), '{_HOST}', 1)) AS host, {_sql_lines()} AS l FROM pages),
hosts AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
lines AS (SELECT row_id, host, i, l[i] AS line FROM (SELECT row_id, host, l, unnest(range(1, len(l) + 1)) AS i FROM p)),
often AS (
  SELECT host, line FROM lines JOIN hosts USING (host) WHERE pages >= {LEAST_PAGES}
  GROUP BY host, line, pages HAVING count(DISTINCT row_id) > pages * {RATIO}::DOUBLE),
kept AS (SELECT row_id, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n FROM lines ANTI JOIN often USING (host, line) GROUP BY row_id)
SELECT page_id, host, len(l)::BIGINT AS n_lines, (len(l) - coalesce(n, 0))::BIGINT AS n_dropped, coalesce(text, '') AS text
FROM p LEFT JOIN kept USING (row_id)
"""
