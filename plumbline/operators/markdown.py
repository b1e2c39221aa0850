"""Pipe tables of Markdown texts as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def pipe_tables(texts: DataFrame) -> DataFrame:
    """Cells of every table row of texts(doc, text): doc, table_ix, row_ix (0 the header), cells.

    Lines that begin with a bar form a table as long as they follow one another; divider
    rows are left out. Islands are found by a window over each text's own lines.
    """
    lines = texts.select("doc", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line", F.trim("line"))
    by_text = W.partitionBy("doc").orderBy("line_no")
    bar = F.col("line").startswith("|")
    marked = lines.withColumn("opens", (bar & ~F.coalesce(F.lag(bar).over(by_text), F.lit(False))).cast("int"))
    tables = marked.withColumn("table_ix", F.sum("opens").over(by_text) - 1).where(bar)
    cells = F.transform(F.split(F.regexp_replace("line", r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = tables.withColumn("cells", cells).where(~F.forall("cells", lambda c: c.rlike(r"^[-: ]+$")))
    return rows.select("doc", "table_ix", (F.row_number().over(W.partitionBy("doc", "table_ix").orderBy("line_no")) - 1).alias("row_ix"), "cells")


def tables_with(texts: DataFrame, *headers: str) -> DataFrame:
    """Body rows (doc, table_ix, row_ix, cells) of every table of texts(doc, text) whose header begins with these cells, in any case."""
    rows = pipe_tables(texts)
    wanted = F.array(*(F.lit(h.lower()) for h in headers))
    head = F.transform(F.slice("cells", 1, len(headers)), F.lower)
    named = rows.where((F.col("row_ix") == 0) & (head == wanted)).select("doc", "table_ix")
    return rows.where("row_ix > 0").join(named, ["doc", "table_ix"], "left_semi")
