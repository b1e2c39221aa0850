"""Python readers as Arrow functions: a batch of values in, a batch of nested rows out."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType, DataType, StructField, StructType


def shows(texts: pa.Array, pattern: str) -> pa.Array:
    """Where a pattern of RE2 is found, in one pass over the batch; false for nulls."""
    return pc.fill_null(pc.match_substring_regex(texts, pattern), False)


def _spread(made: pa.Array, hit: pa.Array) -> pa.Array:
    """made, of the rows of a batch that are hit, at the places of these rows; null at the others."""
    return made.take(pc.if_else(hit, pc.subtract(pc.cumulative_sum(pc.cast(hit, pa.int64())), 1), pa.scalar(None, pa.int64())))


def nested_udf(one: Callable, kind: str, needs: Callable[[pa.Array], pa.Array] | None = None, once: bool = False) -> Callable[..., Column]:
    """A column function that applies `one` to each row of a batch; kind is the DDL of what it gives, dicts for structs.

    A row with a null in its first column gives null. needs tells from the first column which
    rows of a batch are to be read at all; the others give null. With needs, or once, Spark is
    told that the function is not deterministic, else it would call it again for every filter
    on its result.
    """
    returned = DataType.fromDDL(kind)
    arrow = to_arrow_type(returned)

    def batch(*columns: pa.Array) -> pa.Array:
        hit = None if needs is None else needs(columns[0])
        rows = zip(*((c if hit is None else c.filter(hit)).to_pylist() for c in columns), strict=True)
        made = pa.array([None if r[0] is None else one(*r) for r in rows], arrow)
        return made if hit is None else _spread(made, hit)

    made = F.arrow_udf(batch, returned)
    return made.asNondeterministic() if once or needs is not None else made


def sieve(signs: dict[str, str]) -> Callable[[Column], Column]:
    """A column function of texts: which of the signs (patterns of RE2, by name) a text shows, null where it shows none.

    RE2 reads a text once, whatever the pattern. The patterns of checks backtrack, so each is
    tried only where a sign that it cannot match without is shown. A sign may be wider than
    its check, never narrower. Not deterministic for Spark, as in nested_udf.
    """
    returned = StructType([StructField(n, BooleanType()) for n in signs])
    either = "|".join(f"(?:{p})" for p in signs.values())

    def batch(texts: pa.Array) -> pa.Array:
        hit = shows(texts, either)
        some = texts.filter(hit)
        return _spread(pa.StructArray.from_arrays([shows(some, p) for p in signs.values()], list(signs)), hit)

    return F.arrow_udf(batch, returned).asNondeterministic()
