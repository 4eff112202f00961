"""T1-T3 (gap filling, smoothing forecast, guard) and U2 (trend overlay).

The forecast fits an additive-trend exponential smoothing model (no season)
per series key: a task walks the key's ordered daily series once per search
with NumPy, all pairs of smoothing weights together, and the pair with the
least error wins. A series is no longer than the calendar span, since the
incidents were reduced to daily counts before. The functions that run in
Python workers are pickled by value, so executors need no installed copy.
"""

from __future__ import annotations

import sys
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FORECAST_MIN_DAYS, require_columns
from ..session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_SPAN_DAYS = 200 * 366   # a longer calendar means a stray date: an error, never a cut


def densify_daily(series: DataFrame, keys: Sequence[str] = (), date_col: str = "date",
                  value_col: str = "value", observed_col: str | None = None,
                  max_span_days: int = MAX_SPAN_DAYS) -> DataFrame:
    """One row per calendar day from each key's first to last date; gaps -> 0.

    ``observed_col`` (optional) marks days present in the input. The day
    grid is generated per key with ``sequence`` (its size is the calendar
    span) and left-joined to the observations. The series is needed for both,
    so it is computed once and kept under the shared checkpoint folder. A key
    that spans more than ``max_span_days`` holds an implausible date: the job
    fails and names the first and last date, so the caller can filter them.
    """
    require_columns(series, [date_col, value_col, *keys])
    keys = list(keys)
    series = materialize(series.select(*keys, date_col, value_col), "daily-series")
    bounds = series.groupBy(*keys).agg(F.min(date_col).alias("_lo"), F.max(date_col).alias("_hi"))
    too_long = F.raise_error(F.format_string("implausible dates: a series runs from %s to %s",
                                             F.col("_lo").cast("string"), F.col("_hi").cast("string")))
    grid = F.sequence("_lo", "_hi", F.expr("INTERVAL 1 DAY"))
    days_type = f"array<{series.schema[date_col].dataType.simpleString()}>"
    checked = F.when(F.datediff("_hi", "_lo") > F.lit(int(max_span_days)), too_long.cast(days_type)).otherwise(grid)
    days = bounds.select(*keys, F.explode(checked).alias(date_col))
    obs = series.select(*keys, date_col, F.col(value_col), F.lit(True).alias("_obs"))
    out = days.join(obs, on=[*keys, date_col], how="left")
    cols = [*keys, date_col, F.coalesce(F.col(value_col), F.lit(0)).cast(series.schema[value_col].dataType)
            .alias(value_col)]
    if observed_col:
        cols.append(F.coalesce(F.col("_obs"), F.lit(False)).alias(observed_col))
    return out.select(*cols)


# --- additive-trend smoothing fit ------------------------------------------------

#: Searches as (spacing, pairs per side): all of [0, 1] first, then finer lattices around the best pair so far.
WEIGHT_LATTICES = ((0.01, 101), (0.001, 21), (0.0001, 21))
_FIT = "alpha double, beta double, l0 double, b0 double, sse double, level double, trend double"


def _walk(y: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Least squared one-step error, initial state and final state for each weight pair (arrays a, b).

    Errors are linear in the initial level and slope, so three recursions are
    enough for the exactly optimal start: the data from a zero state, a unit
    level and a unit slope without data. All pairs take each day together.
    """
    one = np.ones(len(a))
    l0, t0, l1, t1, l2, t2 = 0 * one, 0 * one, 1 * one, 0 * one, 0 * one, 1 * one
    uu, uv, vv, ur, vr, rr = (np.zeros(len(a)) for _ in range(6))
    keep_a, keep_b = 1 - a, 1 - b
    for value in y:
        p0, u, v = l0 + t0, l1 + t1, l2 + t2
        r = value - p0
        uu += u * u
        uv += u * v
        vv += v * v
        ur += u * r
        vr += v * r
        rr += r * r
        g0, g1, g2 = a * value + keep_a * p0, keep_a * u, keep_a * v
        t0, t1, t2 = b * (g0 - l0) + keep_b * t0, b * (g1 - l1) + keep_b * t1, b * (g2 - l2) + keep_b * t2
        l0, l1, l2 = g0, g1, g2
    det = uu * vv - uv * uv
    with np.errstate(divide="ignore", invalid="ignore"):
        level, slope = (ur * vv - vr * uv) / det, (vr * uu - ur * uv) / det
        sse = rr - 2 * level * ur - 2 * slope * vr + level * level * uu + 2 * level * slope * uv + slope * slope * vv
    sse = np.where(det > 0, np.maximum(sse, 0.0), np.inf)
    return sse, level, slope, l0 + level * l1 + slope * l2, t0 + level * t1 + slope * t2


def best_weights(y: np.ndarray) -> tuple[float, ...] | None:
    """(alpha, beta, initial level and slope, squared error, final level and slope); ties: smaller alpha, then beta."""
    center = (0.5, 0.5)
    best = None
    for step, side in WEIGHT_LATTICES:
        offsets = (np.arange(side) - side // 2) * step
        a, b = (np.repeat(np.clip(center[0] + offsets, 0.0, 1.0), side),
                np.tile(np.clip(center[1] + offsets, 0.0, 1.0), side))
        sse, level, slope, last_level, last_slope = _walk(y, a, b)
        i = np.lexsort((b, a, sse))[0]
        if not np.isfinite(sse[i]):
            return None
        best = tuple(float(c[i]) for c in (a, b, level, slope, sse, last_level, last_slope))
        center = best[:2]
    return best


def fit_trend(trend: DataFrame, keys: Sequence[str], date_col: str = "date", value_col: str = "value",
              min_days: int = FORECAST_MIN_DAYS) -> DataFrame:
    """Smoothing weights, initial state, squared error and final state of each key's daily series.

    The weights are the pair with the least squared one-step error, each pair
    with its exactly optimal initial level and slope: the best of all pairs
    0.01 apart, then of two finer lattices around it (0.0001). Keys with fewer
    than ``min_days`` observed days have no row. A key's daily series (no
    longer than its calendar span) is fitted by one task, which holds it once;
    keys spread over the tasks.
    """
    keys = list(keys)
    dense = densify_daily(trend.select(*keys, date_col, F.col(value_col).cast("double").alias(value_col)),
                          keys=keys, date_col=date_col, value_col=value_col, observed_col="_observed")
    source = dense.select(*keys, F.col(date_col).alias("_date"), F.col(value_col).alias("_value"), "_observed")
    key_types = ", ".join(f"`{k}` {trend.schema[k].dataType.simpleString()}" for k in keys)
    date_type = trend.schema[date_col].dataType.simpleString()

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_date")
        found = best_weights(frame["_value"].to_numpy(dtype=float)) if frame["_observed"].sum() >= min_days else None
        row = [*(frame[k].iloc[0] for k in keys), frame["_date"].iloc[-1], *(found or [])]
        names = [*keys, "last_date", *(c.split()[0] for c in _FIT.split(", "))]
        return pd.DataFrame([row] if found else [], columns=names)

    return source.groupBy(*keys).applyInPandas(fit, f"{key_types}, last_date {date_type}, {_FIT}")


def forecast_collision_trend(trend: DataFrame, horizon_days: int = 30, keys: Sequence[str] = (),
                             date_col: str = "date", value_col: str = "value",
                             min_days: int = FORECAST_MIN_DAYS) -> DataFrame:
    """(keys..., date, value, series_type='Forecast') for ``horizon_days`` after each
    key's last date. Keys with fewer than ``min_days`` observed days (T3) give no rows.
    Values are not clamped at zero.
    """
    keys = list(keys)
    group_keys = keys or ["_series"]
    base = trend if keys else trend.withColumn("_series", F.lit("Total"))
    fitted = fit_trend(base, group_keys, date_col, value_col, min_days)
    ahead = F.explode(F.sequence(F.lit(1), F.lit(int(horizon_days))))
    return (fitted.withColumn("_h", ahead) if int(horizon_days) > 0 else fitted.withColumn("_h", F.lit(0)).limit(0)) \
        .select(*keys, F.expr("last_date + make_dt_interval(_h)").alias(date_col),
                (F.col("level") + F.col("_h") * F.col("trend")).alias(value_col),
                F.lit("Forecast").alias("series_type"))


# ---------------------------------------------------------------------------

def forecast_guard(trend: DataFrame, horizon_days: int, keys: Sequence[str] = (),
                   date_col: str = "date", min_days: int = FORECAST_MIN_DAYS) -> DataFrame:
    """Per key: observed days, whether a forecast is attempted, and whether the
    horizon is longer than the observed days (the low-data warning)."""
    keys = list(keys)
    stats = trend.groupBy(*keys).agg(F.count(date_col).alias("observed_days"))
    return stats.withColumns({
        "enough_data": F.col("observed_days") >= F.lit(int(min_days)),
        "horizon_exceeds_data": F.col("observed_days") < F.lit(int(horizon_days)),
    })


def trend_overlay(severity_trend: DataFrame, total_trend: DataFrame | None = None,
                  forecast: DataFrame | None = None) -> DataFrame:
    """Severity, total and forecast series on one axis: (date, series_type, value)."""
    parts = [severity_trend.select("date", F.col("severity_type").alias("series_type"),
                                   F.col("value").cast("double").alias("value"))]
    if total_trend is not None:
        parts.append(total_trend.select("date", F.lit("Total").alias("series_type"),
                                        F.col("value").cast("double").alias("value")))
    if forecast is not None:
        parts.append(forecast.select("date", "series_type", F.col("value").cast("double").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


__all__ = ["densify_daily", "best_weights", "fit_trend", "forecast_collision_trend", "forecast_guard", "trend_overlay"]
