"""Digests over sets of rows; order is part of each definition."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def package_digest(files: DataFrame, by: str = "pkg_id") -> DataFrame:
    """SHA-256 of path, NUL, content over a package's files in path order; a null text counts as empty.

    A package's files are sorted by Spark, on disk if need be, and stream through one hash,
    so no row or group ever holds a package. The digest itself is sequential by definition.
    """
    kind = files.schema[by].dataType.simpleString()
    rows = files.select(F.col(by).alias("k"), F.col("path").alias("p"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("b"))
    return rows.repartition("k").sortWithinPartitions("k", "p", "b").mapInArrow(_digests, f"`{by}` {kind}, digest string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest for each run of equal keys."""
    name, key, running = None, None, None
    for batch in batches:
        keys, found = batch.column(0), []
        for i, (path, body) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
            if running is None or keys[i] != key:
                if running is not None:
                    found.append((key, running.hexdigest()))
                key, running = keys[i], hashlib.sha256()
            running.update(f"{path.as_py() or ''}\0".encode())
            running.update(body.as_buffer())
        name = keys.type
        if found:
            yield _named(found, name)
    if running is not None:
        yield _named([(key, running.hexdigest())], name)


def _named(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k.as_py() for k, _ in found], kind), pa.array([d for _, d in found])], names=["k", "digest"])


def lock(ids: Column, tiers: Column) -> Column:
    """Aggregate: SHA-256 of the sorted id:tier pairs, joined by bars."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", ids, tiers))), "|"), 256)


def blind_token(*parts: Column) -> Column:
    """A name that does not tell which arm it stands for."""
    return F.concat(F.lit("run-"), F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(10)))
