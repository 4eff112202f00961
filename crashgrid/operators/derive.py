"""Derived columns of the prepared table and display projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import round_half_even, to_number, to_timestamp_any
from ..functions.text import norm_flag, strip
from ..schema import FLAG_COLUMNS, MAP_COLUMNS, require_columns
from ._util import dtype_of


def normalize_flags(df: DataFrame, columns=FLAG_COLUMNS) -> DataFrame:
    """Missing -> "", strip, upper-case, for each flag column present."""
    return df.withColumns({c: norm_flag(c) for c in columns if c in df.columns})


def _fatalities(df: DataFrame):
    return F.coalesce(to_number(F.col("FATALITIES"), dtype_of(df, "FATALITIES")), F.lit(0.0))


def classify_severity(df: DataFrame) -> DataFrame:
    """Fatal > Injury > Property Damage > Other.

    Fatal when numeric FATALITIES > 0 (bad text counts as 0); otherwise by
    the normalised injury / property-damage flags.
    """
    require_columns(df, ["FATALITIES", "INJURY_COLLISIONS", "PD_COLLISIONS"])
    sev = (F.when(_fatalities(df) > 0, "Fatal")
           .when(norm_flag("INJURY_COLLISIONS") == "YES", "Injury")
           .when(norm_flag("PD_COLLISIONS") == "YES", "Property Damage")
           .otherwise("Other"))
    return df.withColumn("severity_class", sev)


def calendar_parts(df: DataFrame) -> DataFrame:
    """OCC_DATE_STR (yyyy-MM-dd), YEAR, MONTH, DAY; null when undated.

    Calendar numbers are doubles, like the other nullable numeric columns.
    """
    require_columns(df, ["OCC_DATE"])
    ts = to_timestamp_any(F.col("OCC_DATE"), dtype_of(df, "OCC_DATE"))
    return df.withColumns({
        "OCC_DATE": ts,
        "OCC_DATE_STR": F.date_format(ts, "yyyy-MM-dd"),
        "YEAR": F.year(ts).cast("double"),
        "MONTH": F.month(ts).cast("double"),
        "DAY": F.dayofmonth(ts).cast("double"),
    })


def fatality_flag(df: DataFrame) -> DataFrame:
    """HAS_FATALITY = numeric FATALITIES (bad -> 0) > 0."""
    require_columns(df, ["FATALITIES"])
    return df.withColumn("HAS_FATALITY", _fatalities(df) > 0)


def grid_cell(df: DataFrame, digits: int = 3) -> DataFrame:
    """P5: lat_cluster / lon_cluster = coordinates rounded half-even to 3 places."""
    require_columns(df, ["LAT_WGS84", "LONG_WGS84"])
    return df.withColumns({
        "lat_cluster": round_half_even(to_number(F.col("LAT_WGS84"), dtype_of(df, "LAT_WGS84")), digits),
        "lon_cluster": round_half_even(to_number(F.col("LONG_WGS84"), dtype_of(df, "LONG_WGS84")), digits),
    })


def trim_dims(df: DataFrame) -> DataFrame:
    """Strip DIVISION and NEIGHBOURHOOD_158 when present; null stays null."""
    return df.withColumns({c: strip(c) for c in ("DIVISION", "NEIGHBOURHOOD_158") if c in df.columns})


def derive(cleaned: DataFrame) -> DataFrame:
    """P3 -> P1 -> P4 -> P2 -> P5 -> P6 on a cleaned table (the body of P7)."""
    return (cleaned.transform(calendar_parts)
            .transform(normalize_flags)
            .transform(fatality_flag)
            .transform(classify_severity)
            .transform(grid_cell)
            .transform(trim_dims))


def map_points(df: DataFrame) -> DataFrame:
    """Map columns that exist (plus the row id), rows with both coordinates.

    Empty (no columns) when coordinates or severity are absent.
    """
    if any(c not in df.columns for c in ("LAT_WGS84", "LONG_WGS84", "severity_class")):
        return df.limit(0).select()
    keep = [c for c in ["EVENT_UNIQUE_ID"] + MAP_COLUMNS if c in df.columns]
    return df.select(*keep).dropna(subset=["LAT_WGS84", "LONG_WGS84"])


_DISPLAY = {
    "hourly": ({"OCC_HOUR": "Hour", "collision_count": "Collisions"}, "Hour"),
    "weekday": ({"day_of_week": "Day", "collision_count": "Collisions"}, None),
    "month": ({"month_name": "Month", "collision_count": "Collisions"}, None),
}


def rename_for_display(result: DataFrame, kind: str) -> DataFrame:
    """Display names for hourly / weekday / month tables (hourly re-sorted by hour)."""
    mapping, order = _DISPLAY[kind]
    out = result.withColumnsRenamed({k: v for k, v in mapping.items() if k in result.columns})
    return out.orderBy(order) if order else out


__all__ = [
    "normalize_flags", "classify_severity", "calendar_parts", "fatality_flag", "grid_cell",
    "trim_dims", "derive", "map_points", "rename_for_display",
]
