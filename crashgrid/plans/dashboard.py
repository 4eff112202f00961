"""One dashboard view: the filter chain and every analysis over its result."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ..operators import aggregates as A
from ..operators.derive import map_points
from ..operators.filters import DashboardParams, filter_chain
from ..operators.sampling import capped_sample
from ..operators.timeseries import forecast_collision_trend, forecast_guard, trend_overlay
from .panels import count_panels
from ..schema import MAP_COLUMNS, ROAD_USERS
from ..sources.export import export_results

# Every column the view's analyses read (count panels, daily trends, map
# points). A persisted view caches only these, not the whole wide row.
VIEW_COLUMNS = list(dict.fromkeys(
    ["EVENT_UNIQUE_ID", "OCC_DATE", "OCC_HOUR", "OCC_DOW", "MONTH", "DIVISION", "NEIGHBOURHOOD_158",
     "severity_class"] + [column for _, column in ROAD_USERS] + MAP_COLUMNS))


def dashboard_view(prepared: DataFrame, params: DashboardParams, map_sample_rows: int,
                   persist: bool | None = None) -> dict[str, DataFrame]:
    """Lazy results of one view.

    ``map_points`` holds every point of the view; ``map_sample`` at most
    ``map_sample_rows`` of them, for display (see ``capped_sample``).

    The filtered rows feed a dozen analyses. When the view is narrowed to
    some years or a recent window (``persist=None``, the default) those rows
    are a slice of the table, and the columns the analyses read
    (``VIEW_COLUMNS``) are persisted once (memory, spilling to disk; a lost
    executor recomputes its blocks from the Parquet scan). A hot year can
    hold a large share of the table, so the cache never holds the whole
    wide row; ``view["filtered"]`` stays the lazy full-width slice (for
    export). An unnarrowed view is not persisted: every panel reads only its
    own columns from Parquet. Call ``release(view)`` when done.
    """
    filtered = filter_chain(prepared, params)
    if persist is None:
        persist = bool(params.years) or params.recent_days is not None
    rows = filtered
    if persist:
        rows = filtered.select(*[c for c in VIEW_COLUMNS if c in filtered.columns]) \
            .persist(StorageLevel.MEMORY_AND_DISK)
    points = map_points(rows)
    # The daily series feed several panels and are no longer than the calendar, so they are always persisted.
    total = A.total_collisions_trend_over_time(rows).persist(StorageLevel.MEMORY_AND_DISK)
    severity = A.severity_trend_over_time(rows, params.severity).persist(StorageLevel.MEMORY_AND_DISK)
    forecast = forecast_collision_trend(total, params.forecast_horizon).persist(StorageLevel.MEMORY_AND_DISK)
    panels = count_panels(rows, top_n=params.top_n)
    shared = panels.pop("_counts")
    return {
        "filtered": filtered,
        **panels,
        "severity_trend": severity,
        "total_trend": total,
        "forecast": forecast,
        "forecast_guard": forecast_guard(total, params.forecast_horizon),
        "trend_overlay": trend_overlay(severity, total, forecast),
        "map_points": points,
        "map_sample": capped_sample(points, map_sample_rows),
        "map_viewport": A.map_viewport(points),
        "map_clusters": A.build_cluster_dataframe(points),
        "_shared_counts": shared,
        "_rows": rows,
    }


def default_params(prepared: DataFrame) -> DashboardParams:
    """The initial view: latest year, last 30 days, all severities, top 10, 7-day forecast.

    Reads one scalar (the latest year) to fill the year selection.
    """
    latest = A.default_year(prepared).first()["default_year"]
    return DashboardParams(years=(int(latest),) if latest is not None else None, recent_days=30,
                           top_n=10, forecast_horizon=7)


def export_view(view: dict[str, DataFrame], path: str) -> str:
    """Write the view's filtered rows as CSV (parallel; one folder of part files)."""
    return export_results(view["filtered"], path)


def release(view: dict[str, DataFrame]) -> None:
    """Drop every persisted frame of the view."""
    for df in view.values():
        if df.is_cached:
            df.unpersist()
