"""Row filters and the dashboard filter chain."""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import to_timestamp_any
from ..schema import ALL_SEVERITIES, SEVERITY_CLASSES, SEVERITY_OTHER, require_columns
from ._util import dtype_of


def _isin(df: DataFrame, column: str, values) -> DataFrame:
    return df.filter(F.col(column).isin(list(values))) if values else df


def filter_collisions(df: DataFrame, years: Sequence[int] | None = None,
                      hours: Sequence[int] | None = None,
                      divisions: Sequence[str] | None = None,
                      neighbourhoods: Sequence[str] | None = None) -> DataFrame:
    """AND of membership tests on OCC_YEAR, OCC_HOUR, DIVISION, NEIGHBOURHOOD_158.

    None or an empty list leaves that dimension unfiltered; a missing value
    never matches. Every predicate reaches the Parquet scan as an ``In`` filter.
    """
    df = _isin(df, "OCC_YEAR", years)
    df = _isin(df, "OCC_HOUR", hours)
    df = _isin(df, "DIVISION", divisions)
    return _isin(df, "NEIGHBOURHOOD_158", neighbourhoods)


def filter_collisions_prepared(df: DataFrame, years: Sequence[int] | None = None,
                               divisions: Sequence[str] | None = None,
                               neighbourhoods: Sequence[str] | None = None) -> DataFrame:
    """as F1 on the prepared table; years test YEAR, else OCC_YEAR."""
    if years:
        if "YEAR" in df.columns:
            df = _isin(df, "YEAR", years)
        elif "OCC_YEAR" in df.columns:
            df = _isin(df, "OCC_YEAR", years)
    df = _isin(df, "DIVISION", divisions)
    return _isin(df, "NEIGHBOURHOOD_158", neighbourhoods)


def filter_by_neighbourhood(df: DataFrame, neighbourhood: str, column: str = "Neighbourhood") -> DataFrame:
    """equality on one neighbourhood column; ``ValueError`` if it is absent."""
    if column not in df.columns:
        raise ValueError("Column not found")
    return df.filter(F.col(column) == F.lit(neighbourhood))


def apply_collision_severity_filter(df: DataFrame, severity: str) -> DataFrame:
    """keep one severity class; "All Severities" or an unknown label keeps all."""
    if severity in SEVERITY_CLASSES or severity == SEVERITY_OTHER:
        return df.filter(F.col("severity_class") == F.lit(severity))
    return df


def apply_recent_days_filter(df: DataFrame, recent_days: int | None, column: str = "OCC_DATE") -> DataFrame:
    """keep rows dated on or after max(date) - n days (inclusive).

    The max is taken over the rows given, so this must run after the other
    filters. No window, no column, or no dated row at all: rows unchanged;
    otherwise undated rows drop. The max is a scalar subquery (one small
    aggregate job), so no join is needed.
    """
    if recent_days is None or column not in df.columns:
        return df
    ts = to_timestamp_any(F.col(column), dtype_of(df, column))
    latest = df.select(F.max(ts)).scalar()
    start = latest - F.make_dt_interval(F.lit(int(recent_days)))
    return df.filter(latest.isNull() | (ts >= start))


def apply_road_user_filter(df: DataFrame, pedestrian: bool = False, bicycle: bool = False,
                           motorcycle: bool = False) -> DataFrame:
    """OR of the chosen road-user flags being exactly 'YES'; none chosen keeps all."""
    chosen = [c for flag, c in ((pedestrian, "PEDESTRIAN"), (bicycle, "BICYCLE"),
                                (motorcycle, "MOTORCYCLE")) if flag and c in df.columns]
    if not chosen:
        return df
    cond = functools.reduce(operator.or_, [F.coalesce(F.col(c) == "YES", F.lit(False)) for c in chosen])
    return df.filter(cond)


@dataclass(frozen=True)
class DashboardParams:
    """Every filter of one dashboard view."""

    years: tuple[int, ...] | None = None
    divisions: tuple[str, ...] | None = None
    neighbourhoods: tuple[str, ...] | None = None
    severity: str = ALL_SEVERITIES
    pedestrian: bool = False
    bicycle: bool = False
    motorcycle: bool = False
    recent_days: int | None = None
    top_n: int = 10
    forecast_horizon: int = 7


def filter_chain(df: DataFrame, params: DashboardParams) -> DataFrame:
    """F2 -> F4 -> F6 -> F5; the recent window is relative to rows already filtered."""
    return (df.transform(lambda d: filter_collisions_prepared(
                d, years=params.years, divisions=params.divisions, neighbourhoods=params.neighbourhoods))
            .transform(lambda d: apply_collision_severity_filter(d, params.severity))
            .transform(lambda d: apply_road_user_filter(
                d, pedestrian=params.pedestrian, bicycle=params.bicycle, motorcycle=params.motorcycle))
            .transform(lambda d: apply_recent_days_filter(d, params.recent_days)))


def filter_classes(df: DataFrame, classes: Sequence[str]) -> DataFrame:
    """F8: rows of the given classes with their position in ``classes`` as draw_order (1-based)."""
    require_columns(df, ["severity_class"])
    order = F.array(*[F.lit(c) for c in classes])
    return (df.filter(F.col("severity_class").isin(list(classes)))
            .withColumn("draw_order", F.array_position(order, F.col("severity_class")).cast("int")))


def drop_missing_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """drop rows where any grouping key is null."""
    return df.dropna(subset=list(keys))
