"""Cleaning of the raw incident table and the raw-data quality report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import to_number, to_timestamp_any
from ..functions.text import strip
from ..schema import NUMERIC_COLUMNS, PLACEHOLDER_NEIGHBOURHOODS, require_columns
from ._util import dtype_of


def dedupe_rows(df: DataFrame) -> DataFrame:
    """Drop exact duplicate rows (nulls compare equal).

    Runs before any coercion, so "8" and "8.0" rows stay distinct. One hash
    aggregate on all columns; map-side partial aggregation collapses a hot
    group of copies before the shuffle.
    """
    return df.dropDuplicates()


def coerce_timestamp(df: DataFrame, column: str = "OCC_DATE") -> DataFrame:
    """Text -> timestamp (several layouts); anything else -> null."""
    require_columns(df, [column])
    return df.withColumn(column, to_timestamp_any(F.col(column), dtype_of(df, column)))


def coerce_numeric(df: DataFrame, columns=NUMERIC_COLUMNS) -> DataFrame:
    """Text -> double for the numeric columns; bad text / NaN -> null."""
    require_columns(df, columns)
    return df.withColumns({c: to_number(F.col(c), dtype_of(df, c)) for c in columns})


def placeholder_to_null(c) -> F.Column:
    """Stripped text, or null when it is a placeholder (case-insensitive)."""
    t = strip(F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("")))
    return F.when(F.upper(t).isin(PLACEHOLDER_NEIGHBOURHOODS), F.lit(None).cast("string")).otherwise(t)


def null_placeholders(df: DataFrame, column: str = "NEIGHBOURHOOD_158") -> DataFrame:
    """C4: strip the neighbourhood; NSA / UNKNOWN / N/A / NONE / blank -> null.

    The surviving text keeps its case.
    """
    require_columns(df, [column])
    return df.withColumn(column, placeholder_to_null(column))


def quality_flags(df: DataFrame) -> DataFrame:
    """HAS_VALID_COORDINATES (both present, both non-zero), HAS_VALID_NEIGHBOURHOOD."""
    require_columns(df, ["LAT_WGS84", "LONG_WGS84", "NEIGHBOURHOOD_158"])
    lat, lon = F.col("LAT_WGS84"), F.col("LONG_WGS84")
    # a missing coordinate makes the comparison null, which coalesce turns into False
    valid = F.coalesce((lat != 0) & (lon != 0), F.lit(False))
    return df.withColumns({
        "HAS_VALID_COORDINATES": valid,
        "HAS_VALID_NEIGHBOURHOOD": F.col("NEIGHBOURHOOD_158").isNotNull(),
    })


def drop_invalid_coords(df: DataFrame) -> DataFrame:
    """Keep rows flagged with valid coordinates."""
    require_columns(df, ["HAS_VALID_COORDINATES"])
    return df.filter(F.col("HAS_VALID_COORDINATES"))


def clean(df: DataFrame) -> DataFrame:
    """C1 -> C2 -> C3 -> C4 -> C5 -> C6 as one lazy plan."""
    return (df.transform(dedupe_rows)
            .transform(coerce_timestamp)
            .transform(coerce_numeric)
            .transform(null_placeholders)
            .transform(quality_flags)
            .transform(drop_invalid_coords))


def quality_report(df: DataFrame) -> DataFrame:
    """One-row report on the raw rows.

    total_rows, duplicate_rows, missing_occ_date, missing_occ_hour,
    invalid_coordinates, placeholder_neighbourhoods (missing = null only;
    the placeholder test upper-cases without stripping), plus
    unparseable_occ_date (present but not a date).

    One shuffle: rows are first grouped on all columns (the map side collapses
    copies), every measure is then a count weighted by the group size, so the
    duplicate count needs no second scan and no join.
    """
    require_columns(df, ["OCC_DATE", "OCC_HOUR", "LAT_WGS84", "LONG_WGS84", "NEIGHBOURHOOD_158"])
    n = "__crashgrid_rows"
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(n))
    lat = to_number(F.col("LAT_WGS84"), dtype_of(df, "LAT_WGS84"))
    lon = to_number(F.col("LONG_WGS84"), dtype_of(df, "LONG_WGS84"))
    invalid = (lat == 0) | (lon == 0) | lat.isNull() | lon.isNull()
    placeholder = F.coalesce(F.upper(F.col("NEIGHBOURHOOD_158").cast("string")), F.lit("")) \
        .isin(PLACEHOLDER_NEIGHBOURHOODS)
    parsed = to_timestamp_any(F.col("OCC_DATE"), dtype_of(df, "OCC_DATE"))

    def weighted(cond):
        return F.coalesce(F.sum(F.when(cond, F.col(n)).otherwise(F.lit(0))), F.lit(0)).cast("bigint")

    return groups.agg(
        F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("total_rows"),
        (F.coalesce(F.sum(n), F.lit(0)) - F.count(F.lit(1))).cast("bigint").alias("duplicate_rows"),
        weighted(F.col("OCC_DATE").isNull()).alias("missing_occ_date"),
        weighted(F.col("OCC_HOUR").isNull()).alias("missing_occ_hour"),
        weighted(F.coalesce(invalid, F.lit(True))).alias("invalid_coordinates"),
        weighted(placeholder).alias("placeholder_neighbourhoods"),
        weighted(F.col("OCC_DATE").isNotNull() & parsed.isNull()).alias("unparseable_occ_date"),
    )
