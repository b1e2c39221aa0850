"""Column expressions, built from JVM-side functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value worked out once for a row; keeps nested expressions from multiplying."""
    return F.transform(F.array(value), body)[0]
