"""All count panels of a view from one pass over its rows.

Each row emits weighted (panel, key) entries; a single aggregate (partial
sums combined in every task before the shuffle) yields a table with one row
per panel key -- a few hundred rows however large the input. Every panel is
then derived from that small table, so the rows are scanned once instead of
once per panel. Each derived panel has the same rows and columns as the
single-analysis operator it replaces (tests compare them).
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import to_number
from ..operators._util import dtype_of, empty_frame
from ..operators.aggregates import month_name, weekday_rank
from ..schema import PEAK_HOUR_NONE_DASHBOARD, ROAD_USERS, SEVERITY_CLASSES, require_columns


def _entry(panel: str, key, weight=None):
    w = F.lit(1) if weight is None else F.coalesce(weight.cast("int"), F.lit(0))
    return F.struct(F.lit(panel).alias("panel"), key.cast("string").alias("key"), w.cast("bigint").alias("w"))


def panel_counts(df: DataFrame) -> DataFrame:
    """(panel, key, n) for every count panel, from one aggregate over ``df``."""
    entries = [_entry("rows", F.lit(""))]
    for panel, column in (("hour", "OCC_HOUR"), ("neighbourhood", "NEIGHBOURHOOD_158"),
                          ("division", "DIVISION"), ("dow", "OCC_DOW")):
        if column in df.columns:
            entries.append(F.when(F.col(column).isNotNull(), _entry(panel, F.col(column))))
    if "MONTH" in df.columns:
        m = to_number(F.col("MONTH"), dtype_of(df, "MONTH")).try_cast("int")
        entries.append(F.when(m.isNotNull(), _entry("month", m)))
    if "severity_class" in df.columns:
        entries += [_entry("severity", F.lit(c), F.col("severity_class") == c) for c in SEVERITY_CLASSES]
    for label, column in ROAD_USERS:
        if column in df.columns:
            entries.append(_entry("road", F.lit(label), F.col(column) == "YES"))
    return (df.select(F.explode(F.array(*entries)).alias("e"))
            .filter(F.col("e").isNotNull())
            .groupBy("e.panel", "e.key").agg(F.sum("e.w").alias("n")))


def count_panels(df: DataFrame, top_n: int = 10,
                 empty_peak_label: str = PEAK_HOUR_NONE_DASHBOARD) -> dict[str, DataFrame]:
    """The count panels of a view; the shared small table is persisted (see ``release_panels``)."""
    require_columns(df, ["OCC_HOUR", "NEIGHBOURHOOD_158"])
    counts = panel_counts(df).persist(StorageLevel.MEMORY_AND_DISK)

    def panel(name):
        return counts.filter(F.col("panel") == name)

    def total(name, key=None):
        cond = (F.col("panel") == name) if key is None else ((F.col("panel") == name) & (F.col("key") == key))
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("bigint")

    hour_type = dtype_of(df, "OCC_HOUR")
    hours = panel("hour").select(F.col("key").cast(hour_type).alias("OCC_HOUR"),
                                 F.col("n").alias("collision_count"))
    out = {"_counts": counts,
           "by_hour": hours.orderBy(F.desc("collision_count"), F.asc("OCC_HOUR"))}

    peak = hours.agg(F.max_by(F.col("OCC_HOUR"), F.struct(F.col("collision_count"), -F.col("OCC_HOUR")))
                     .alias("peak_hour_value"))
    label = F.when(F.col("peak_hour_value").isNull(), F.lit(empty_peak_label)) \
        .otherwise(F.format_string("%02d:00", F.col("peak_hour_value").cast("int")))
    out["peak_hour"] = peak.select(F.col("peak_hour_value").cast("int").alias("peak_hour_value"),
                                   label.alias("peak_hour"))

    for name, column in (("by_neighbourhood", "NEIGHBOURHOOD_158"), ("by_division", "DIVISION")):
        short = "neighbourhood" if column == "NEIGHBOURHOOD_158" else "division"
        if column in df.columns:
            out[name] = (panel(short).select(F.col("key").alias(column), F.col("n").alias("collision_count"))
                         .orderBy(F.desc("collision_count"), F.asc(column)).limit(int(top_n)))
        elif name == "by_division":
            out[name] = empty_frame(df, "DIVISION string, collision_count bigint")

    if "severity_class" in df.columns:
        pairs = ", ".join(f"'{c}', _s{i}" for i, c in enumerate(SEVERITY_CLASSES))
        out["severity"] = (counts.agg(*[total("severity", c).alias(f"_s{i}") for i, c in enumerate(SEVERITY_CLASSES)])
                           .selectExpr(f"stack({len(SEVERITY_CLASSES)}, {pairs}) as (severity_type, value)"))
    else:
        out["severity"] = empty_frame(df, "severity_type string, value bigint")

    road_pairs = ", ".join(f"'{label}', _r{i}" for i, (label, _) in enumerate(ROAD_USERS))
    out["road_users"] = (counts.agg(*[total("road", label).alias(f"_r{i}") for i, (label, _) in enumerate(ROAD_USERS)])
                         .selectExpr(f"stack({len(ROAD_USERS)}, {road_pairs}) as (road_user_type, collision_count)"))

    if "OCC_DOW" in df.columns:
        rank = weekday_rank(F.col("key"))
        out["by_day_of_week"] = (panel("dow").orderBy(rank.asc_nulls_last(), F.asc("key"))
                                 .select(F.when(rank.isNotNull(), F.col("key")).alias("day_of_week"),
                                         F.col("n").alias("collision_count")))
    else:
        out["by_day_of_week"] = empty_frame(df, "day_of_week string, collision_count bigint")

    if "MONTH" in df.columns:
        months = panel("month").select(F.col("key").cast("int").alias("month"), F.col("n").alias("collision_count"))
        out["by_month"] = months.withColumn("month_name", month_name(F.col("month"))).orderBy("month")
    else:
        out["by_month"] = empty_frame(df, "month_name string, collision_count bigint")

    def flag_total(column, label):
        return total("road", label) if column in df.columns else F.lit(0).cast("bigint")
    out["kpis"] = counts.agg(
        total("rows").alias("total_collisions"),
        total("severity", "Fatal").alias("fatal"), total("severity", "Injury").alias("injury"),
        total("severity", "Property Damage").alias("property_damage"),
        flag_total("PEDESTRIAN", "Pedestrian").alias("pedestrian"),
        flag_total("BICYCLE", "Bicycle").alias("bicycle"),
        flag_total("MOTORCYCLE", "Motorcycle").alias("motorcycle"))
    return out
