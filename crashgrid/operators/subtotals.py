"""Cube, rollup and chosen grouping sets in one expand-based aggregate."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import require_columns


def _totals(grouped, dims: Sequence[str]) -> DataFrame:
    flags = [F.grouping(c).cast("boolean").alias(f"all_{c}") for c in dims]
    return grouped.agg(F.count(F.lit(1)).alias("collision_count"), *flags,
                       F.grouping_id().cast("int").alias("grouping_id")).select(
        *dims, *[f"all_{c}" for c in dims], "grouping_id", "collision_count")


def cube_counts(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Counts for every subset of ``dims``.

    ``all_<dim>`` is true on subtotal rows over the dimension and tells them
    from rows whose value is null. Rows are expanded once per subset inside
    the task and combined there, so one shuffle moves partial counts only.
    """
    require_columns(df, list(dims))
    return _totals(df.cube(*dims), dims)


def rollup_counts(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Counts for every prefix of ``dims``, the empty one included; columns as ``cube_counts``."""
    require_columns(df, list(dims))
    return _totals(df.rollup(*dims), dims)


def grouping_set_counts(df: DataFrame, sets: Sequence[Sequence[str]], dims: Sequence[str]) -> DataFrame:
    """Counts for the chosen subsets of ``dims``; columns as ``cube_counts``."""
    require_columns(df, list(dims))
    return _totals(df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in dims]), dims)
