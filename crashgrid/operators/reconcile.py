"""The same metrics from the raw-clean path and the prepared path, side by side.

Each path's metrics come from one linear plan: every row emits weighted
(metric, key) entries, a single aggregate sums them (partial sums are
combined in each task before the shuffle), and window functions over the
aggregated table pick the peak hour and the top neighbourhoods. No
branch of the plan re-reads a path, so each input is scanned once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_flag
from ..schema import ROAD_USERS, SEVERITY_CLASSES


def _entry(metric, key, weight):
    return F.struct(F.lit(metric).alias("metric"), key.cast("string").alias("key"),
                    weight.cast("bigint").alias("w"))


def metric_table(df: DataFrame, normalized_road_users: bool, top_n: int = 10) -> DataFrame:
    """Long (metric, key, value) table of the validation metrics of one path.

    Metrics follow the single-analysis operators: row_count (A17), by_hour
    and peak_hour (A1, A14; 'N/A' without hours), top_neighbourhood (A2,
    count desc then name), severity (A4, only when severity_class exists),
    road_user (A7 exact 'YES', or A8 after normalising). A path without rows
    reports no metrics.
    """
    hour = F.col("OCC_HOUR").try_cast("double")
    whole = hour.try_cast("bigint")
    hour = F.when(hour == whole, whole.cast("string")).otherwise(hour.cast("string"))
    one = F.lit(1)
    entries = [
        _entry("row_count", F.lit(""), one),
        F.when(hour.isNotNull(), _entry("by_hour", hour, one)),
        _entry("has_hour", F.lit(""), hour.isNotNull().cast("int")),
        F.when(F.col("NEIGHBOURHOOD_158").isNotNull(), _entry("neighbourhood", F.col("NEIGHBOURHOOD_158"), one)),
    ]
    if "severity_class" in df.columns:
        entries += [_entry("severity", F.lit(c), F.coalesce((F.col("severity_class") == c).cast("int"), F.lit(0)))
                    for c in SEVERITY_CLASSES]
    for label, column in ROAD_USERS:
        if column in df.columns:
            value = norm_flag(column) if normalized_road_users else F.col(column)
            hit = F.coalesce((value == "YES").cast("int"), F.lit(0))
        else:
            hit = F.lit(0)
        entries.append(_entry("road_user", F.lit(label), hit))

    counts = (df.select(F.explode(F.array(*entries)).alias("e"))
              .filter(F.col("e").isNotNull())
              .groupBy("e.metric", "e.key").agg(F.sum("e.w").alias("value")))

    # hours tie by their number, names by their text, as in the single analyses
    number = F.when(F.col("metric") == "by_hour", F.col("key").try_cast("double"))
    order = [F.desc("value"), number.asc_nulls_last(), F.asc("key")]
    # Two levels: the best N names and the best hour inside each of 64 key buckets (parallel), then the final
    # rank over those candidates only (at most 64 * N and 64), so no task sorts every distinct name or hour.
    bucket = F.pmod(F.xxhash64("key"), F.lit(64))
    in_bucket = Window.partitionBy("metric", "_bucket").orderBy(*order)
    places = F.when(F.col("metric") == "neighbourhood", F.lit(int(top_n))).otherwise(F.lit(1))
    reduced = (counts.withColumn("_bucket", bucket)
               .withColumn("_r", F.row_number().over(in_bucket))
               .withColumn("_candidate", F.col("_r") <= places)
               .filter((F.col("metric") != "neighbourhood") | F.col("_candidate")))
    last = Window.partitionBy("metric", F.when(~F.col("_candidate"), F.col("_bucket"))).orderBy(*order)
    ranked = reduced.withColumn("_rank", F.when(F.col("_candidate"), F.row_number().over(last)))
    peak = F.when((F.col("metric") == "by_hour") & (F.col("_rank") == 1),
                  F.struct(F.lit("peak_hour").alias("metric"),
                           F.format_string("%02d:00", F.col("key").cast("double").cast("int")).alias("key"),
                           F.lit(1).cast("bigint").alias("value"))) \
        .when((F.col("metric") == "has_hour") & (F.col("value") == 0),
              F.struct(F.lit("peak_hour").alias("metric"), F.lit("N/A").alias("key"),
                       F.lit(1).cast("bigint").alias("value")))
    own = F.when((F.col("metric") != "has_hour")
                 & ((F.col("metric") != "neighbourhood") | (F.col("_rank") <= int(top_n))),
                 F.struct(F.when(F.col("metric") == "neighbourhood", F.lit("top_neighbourhood"))
                          .otherwise(F.col("metric")).alias("metric"),
                          F.col("key"), F.col("value").cast("bigint").alias("value")))
    return (ranked.select(F.explode(F.array(own, peak)).alias("r"))
            .filter(F.col("r").isNotNull())
            .select("r.metric", "r.key", "r.value"))


def reconcile_paths(cleaned: DataFrame, prepared: DataFrame) -> DataFrame:
    """Full outer join of both metric tables on (metric, key).

    Each side reports whether it has the metric (in_raw / in_prepared) and its
    value (0 when absent); difference = prepared - raw.
    """
    raw = metric_table(cleaned, normalized_road_users=False) \
        .select("metric", "key", F.col("value").alias("raw_value"), F.lit(True).alias("in_raw"))
    prep = metric_table(prepared, normalized_road_users=True) \
        .select("metric", "key", F.col("value").alias("prepared_value"), F.lit(True).alias("in_prepared"))
    joined = raw.join(prep, on=["metric", "key"], how="full")
    raw_v = F.coalesce(F.col("raw_value"), F.lit(0)).cast("bigint")
    prep_v = F.coalesce(F.col("prepared_value"), F.lit(0)).cast("bigint")
    return (joined.select("metric", "key",
                          F.coalesce("in_raw", F.lit(False)).alias("in_raw"), raw_v.alias("raw_value"),
                          F.coalesce("in_prepared", F.lit(False)).alias("in_prepared"),
                          prep_v.alias("prepared_value"), (prep_v - raw_v).alias("difference"))
            .orderBy("metric", "key"))
