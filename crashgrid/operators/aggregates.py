"""Counts, rankings, KPIs and map statistics.

All are single-pass hash aggregates with map-side partial aggregation, so a
key holding a large share of rows is pre-combined in every task before the
shuffle. Fixed-category summaries use one global aggregate plus ``stack`` so
absent categories still report zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import to_number, to_timestamp_any
from ..functions.text import norm_flag
from ..schema import (ALL_SEVERITIES, MONTH_NAMES, PEAK_HOUR_NONE_REPORT, ROAD_USERS,
                      ROAD_USERS_WITH_AUTOMOBILE, SEVERITY_CLASSES, WEEKDAYS, ZOOM_LADDER, ZOOM_WIDEST,
                      require_columns)
from ._util import dtype_of, empty_frame


def _count_by(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("collision_count"))


def collisions_by_hour(df: DataFrame) -> DataFrame:
    """A1: (OCC_HOUR, collision_count), count desc then hour asc; missing hours ignored."""
    require_columns(df, ["OCC_HOUR"])
    return _count_by(df, "OCC_HOUR").orderBy(F.desc("collision_count"), F.asc("OCC_HOUR"))


def top_counts(df: DataFrame, key: str, top_n: int | None) -> DataFrame:
    """Count per key, count desc with the key ascending as tie-break, first ``top_n``.

    ``orderBy + limit`` plans as TakeOrderedAndProject: each task keeps its
    own top n and only those reach the final merge.
    """
    ranked = _count_by(df, key).orderBy(F.desc("collision_count"), F.asc(key))
    return ranked.limit(int(top_n)) if top_n is not None else ranked


def collisions_by_neighbourhood(df: DataFrame, top_n: int = 10) -> DataFrame:
    """A2: top neighbourhoods by count; ``ValueError`` when the column is missing."""
    require_columns(df, ["NEIGHBOURHOOD_158"])
    return top_counts(df, "NEIGHBOURHOOD_158", top_n)


def collisions_by_division(df: DataFrame, top_n: int = 10) -> DataFrame:
    """A3: top divisions by count; empty frame when the column is missing."""
    if "DIVISION" not in df.columns:
        return empty_frame(df, "DIVISION string, collision_count bigint")
    return top_counts(df, "DIVISION", top_n)


def _stacked_counts(df: DataFrame, labels_and_conds, label_col: str, value_col: str) -> DataFrame:
    """One global aggregate of conditional counts, unpivoted to (label, value) rows."""
    aggs = [F.count_if(F.coalesce(cond, F.lit(False))).alias(f"_c{i}")
            for i, (_, cond) in enumerate(labels_and_conds)]
    one = df.agg(*aggs)
    pairs = ", ".join(f"'{label}', _c{i}" for i, (label, _) in enumerate(labels_and_conds))
    return one.selectExpr(f"stack({len(labels_and_conds)}, {pairs}) as ({label_col}, {value_col})")


def collision_severity_analysis(df: DataFrame) -> DataFrame:
    """A4: exactly Fatal, Injury, Property Damage with counts (zeros kept, Other left out).

    Empty frame when severity_class is absent.
    """
    if "severity_class" not in df.columns:
        return empty_frame(df, "severity_type string, value bigint")
    conds = [(c, F.col("severity_class") == c) for c in SEVERITY_CLASSES]
    return _stacked_counts(df, conds, "severity_type", "value")


def weekday_rank(c):
    """1..7 for Monday..Sunday, null for any other label."""
    pos = F.array_position(F.array(*[F.lit(d) for d in WEEKDAYS]), c)
    return F.when(pos > 0, pos)


def collisions_by_day_of_week(df: DataFrame) -> DataFrame:
    """A5: (day_of_week, collision_count) in Monday..Sunday order.

    Counts are per label; a label that is not a weekday name keeps its own
    count but its day_of_week is null (it is not one of the ordered
    categories), and such rows sort last.
    """
    if "OCC_DOW" not in df.columns:
        return empty_frame(df, "day_of_week string, collision_count bigint")
    counts = _count_by(df, "OCC_DOW")
    rank = weekday_rank(F.col("OCC_DOW"))
    return (counts.orderBy(rank.asc_nulls_last(), F.asc("OCC_DOW"))
            .select(F.when(rank.isNotNull(), F.col("OCC_DOW")).alias("day_of_week"), "collision_count"))


def month_name(c):
    """English month name for 1..12, null otherwise."""
    names = F.array(*[F.lit(m) for m in MONTH_NAMES])
    return F.when((c >= 1) & (c <= 12), F.get(names, c - 1))


def collisions_by_month(df: DataFrame) -> DataFrame:
    """(month, collision_count, month_name) ascending by month.

    MONTH is coerced to a number and truncated; missing or bad values are
    ignored; months outside 1..12 keep their count with a null name. A
    missing MONTH column gives the empty (month_name, collision_count) frame.
    """
    if "MONTH" not in df.columns:
        return empty_frame(df, "month_name string, collision_count bigint")
    m = to_number(F.col("MONTH"), dtype_of(df, "MONTH")).try_cast("int")
    counts = (df.select(m.alias("month")).filter(F.col("month").isNotNull())
              .groupBy("month").agg(F.count(F.lit(1)).alias("collision_count")))
    return counts.withColumn("month_name", month_name(F.col("month"))).orderBy("month")


def _road_user_counts(df: DataFrame, users, normalise: bool) -> DataFrame:
    conds = []
    for label, column in users:
        if column in df.columns:
            value = norm_flag(column) if normalise else F.col(column)
            conds.append((label, value == "YES"))
        else:
            conds.append((label, F.lit(False)))
    return _stacked_counts(df, conds, "road_user_type", "collision_count")


def road_user_analysis(df: DataFrame) -> DataFrame:
    """Pedestrian / Bicycle / Motorcycle rows with the count of exact 'YES' (absent column: 0)."""
    return _road_user_counts(df, ROAD_USERS, normalise=False)


def road_user_summary_normalized(df: DataFrame) -> DataFrame:
    """As A7 after stripping and upper-casing the flags."""
    return _road_user_counts(df, ROAD_USERS, normalise=True)


def road_user_with_automobile(df: DataFrame) -> DataFrame:
    """Four road-user types including Automobile, counting 'YES'."""
    return _road_user_counts(df, ROAD_USERS_WITH_AUTOMOBILE, normalise=False)


def day_start(ts):
    """Midnight of the timestamp's day (a timestamp, like a datetime day key)."""
    return F.date_trunc("day", ts).cast("timestamp_ntz")


def _dated(df: DataFrame) -> DataFrame:
    ts = to_timestamp_any(F.col("OCC_DATE"), dtype_of(df, "OCC_DATE"))
    return df.withColumn("date", day_start(ts)).filter(F.col("date").isNotNull())


def severity_trend_over_time(df: DataFrame, selected_severity: str = ALL_SEVERITIES) -> DataFrame:
    """A10: (date, severity_type, value) per day and class.

    "All Severities" = Fatal, Injury and Property Damage; one of those =
    that class only; anything else (including "Other") = empty.
    """
    empty = "date timestamp_ntz, severity_type string, value bigint"
    if "OCC_DATE" not in df.columns or "severity_class" not in df.columns:
        return empty_frame(df, empty)
    if selected_severity == ALL_SEVERITIES:
        chosen = list(SEVERITY_CLASSES)
    elif selected_severity in SEVERITY_CLASSES:
        chosen = [selected_severity]
    else:
        return empty_frame(df, empty)
    return (_dated(df.filter(F.col("severity_class").isin(chosen)))
            .groupBy("date", F.col("severity_class").alias("severity_type"))
            .agg(F.count(F.lit(1)).alias("value"))
            .orderBy("date", "severity_type"))


def total_collisions_trend_over_time(df: DataFrame) -> DataFrame:
    """(date, value) per day over every class, including Other."""
    if "OCC_DATE" not in df.columns:
        return empty_frame(df, "date timestamp_ntz, value bigint")
    return _dated(df).groupBy("date").agg(F.count(F.lit(1)).alias("value")).orderBy("date")


def build_cluster_dataframe(map_df: DataFrame) -> DataFrame:
    """Count per (lat_cluster, lon_cluster, severity_class), cells named as coordinates."""
    if any(c not in map_df.columns for c in ("lat_cluster", "lon_cluster", "severity_class")):
        return empty_frame(map_df, "LAT_WGS84 double, LONG_WGS84 double, severity_class string, "
                                   "collision_count bigint")
    return (map_df.groupBy(F.col("lat_cluster").alias("LAT_WGS84"), F.col("lon_cluster").alias("LONG_WGS84"),
                           "severity_class")
            .agg(F.count(F.lit(1)).alias("collision_count")))


def kpis(df: DataFrame) -> DataFrame:
    """One row of headline counts (absent columns count 0)."""
    def eq(column, value):
        return F.count_if(F.coalesce(F.col(column) == value, F.lit(False))) if column in df.columns \
            else F.lit(0).cast("bigint")
    return df.agg(
        F.count(F.lit(1)).alias("total_collisions"),
        eq("severity_class", "Fatal").alias("fatal"),
        eq("severity_class", "Injury").alias("injury"),
        eq("severity_class", "Property Damage").alias("property_damage"),
        eq("PEDESTRIAN", "YES").alias("pedestrian"),
        eq("BICYCLE", "YES").alias("bicycle"),
        eq("MOTORCYCLE", "YES").alias("motorcycle"),
    )


def peak_hour(df: DataFrame, empty_label: str = PEAK_HOUR_NONE_REPORT) -> DataFrame:
    """One row: the hour ranked first by A1 (peak_hour_value) and its 'HH:00' label.

    ``empty_label`` ('N/A' in reports, '-' on the dashboard) when there is no hour at all.
    """
    require_columns(df, ["OCC_HOUR"])
    counts = _count_by(df, "OCC_HOUR")
    hour = F.max_by(F.col("OCC_HOUR"), F.struct(F.col("collision_count"), -F.col("OCC_HOUR")))
    one = counts.agg(hour.alias("peak_hour_value"))
    label = F.when(F.col("peak_hour_value").isNull(), F.lit(empty_label)) \
        .otherwise(F.format_string("%02d:00", F.col("peak_hour_value").cast("int")))
    return one.select(F.col("peak_hour_value").cast("int").alias("peak_hour_value"), label.alias("peak_hour"))


def distinct_options(df: DataFrame) -> DataFrame:
    """Sorted distinct years, divisions, neighbourhoods as (option, value) rows.

    One scan: each row contributes one (option, value) entry per dimension,
    and a single distinct aggregate (pre-combined in every task) keeps them.
    The default year (the latest) is given by ``default_year``.
    """
    entries = []
    if "YEAR" in df.columns:
        entries.append(("year", F.col("YEAR").try_cast("bigint").cast("string")))
    for option, column in (("division", "DIVISION"), ("neighbourhood", "NEIGHBOURHOOD_158")):
        if column in df.columns:
            entries.append((option, F.col(column).cast("string")))
    if not entries:
        return empty_frame(df, "option string, value string")
    structs = [F.struct(F.lit(o).alias("option"), v.alias("value")) for o, v in entries]
    return (df.select(F.explode(F.array(*structs)).alias("e"))
            .select("e.option", "e.value").dropna().distinct().orderBy("option", "value"))


def default_year(df: DataFrame) -> DataFrame:
    """One row with the year preselected in a view: the latest year (null if none)."""
    require_columns(df, ["YEAR"])
    return df.agg(F.max(F.col("YEAR")).try_cast("bigint").alias("default_year"))


def map_viewport(map_df: DataFrame) -> DataFrame:
    """Centre (mean lat/long), ranges, spread (larger range) and zoom band."""
    require_columns(map_df, ["LAT_WGS84", "LONG_WGS84"])
    lat, lon = F.col("LAT_WGS84"), F.col("LONG_WGS84")
    stats = map_df.agg(
        F.avg(lat).alias("center_lat"), F.avg(lon).alias("center_lon"),
        (F.max(lat) - F.min(lat)).alias("lat_range"), (F.max(lon) - F.min(lon)).alias("lon_range"),
        F.count(F.lit(1)).alias("points"),
    )
    spread = F.greatest(F.col("lat_range"), F.col("lon_range"))
    zoom = None
    for bound, level in ZOOM_LADDER:
        zoom = F.when(spread < bound, level) if zoom is None else zoom.when(spread < bound, level)
    zoom = zoom.otherwise(ZOOM_WIDEST)
    return stats.withColumns({"spread": spread, "zoom": F.when(spread.isNotNull(), zoom).cast("int")})


def row_count(df: DataFrame) -> DataFrame:
    """One row with the number of rows."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))
