"""Small helpers shared by operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def empty_frame(df: DataFrame, ddl: str) -> DataFrame:
    """An empty result with a fixed schema, still planned from ``df``.

    Used where an analysis cannot run (its column is absent) but callers
    expect a typed, lazily evaluated frame.
    """
    cols = []
    for part in ddl.split(","):
        name, dtype = part.strip().split(None, 1)
        cols.append(F.lit(None).cast(dtype).alias(name))
    return df.limit(0).select(*cols)


def dtype_of(df: DataFrame, name: str):
    return df.schema[name].dataType
