"""Mergeable sketches: daily distinct counts and quantiles, stored as bytes and merged for any range of days.

Merging costs one row per day whatever the number of events, and the error is
bounded: a HyperLogLog sketch with 2**lg_config_k registers has a relative
standard error of about 1.04 / sqrt(2**lg_config_k), a KLL sketch of size k a
rank error of about 2.3 / k**0.9 (99 %).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import require_columns

HLL_BITS = 12
KLL_K = 200


def daily_sketches(events: DataFrame, time_col: str, distinct_col: str, value_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, day, rows, distinct_sketch, value_sketch): one row per key and day; nulls are not counted.

    Tasks sketch their own rows, so the shuffle moves a few KB per task, key
    and day.
    """
    require_columns(events, [time_col, distinct_col, value_col, *keys])
    return events.groupBy(*keys, F.col(time_col).cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg(distinct_col, F.lit(HLL_BITS)).alias("distinct_sketch"),
        F.kll_sketch_agg_double(F.col(value_col).cast("double"), F.lit(KLL_K)).alias("value_sketch"))


def merge_sketches(daily: DataFrame, period: Column, quantiles: Sequence[float] = (0.5, 0.9),
                   keys: Sequence[str] = ()) -> DataFrame:
    """Estimates per key and ``period`` (an expression of ``day``) from the stored daily sketches alone."""
    merged = daily.groupBy(*keys, period.alias("period")).agg(
        F.sum("rows").alias("rows"), F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("distinct_estimate"),
        F.kll_merge_agg_double("value_sketch").alias("_values"))
    return merged.withColumns({f"q{int(round(q * 100))}": F.kll_sketch_get_quantile_double("_values", F.lit(float(q)))
                               for q in quantiles}).drop("_values")


def distinct_error(lg_config_k: int = HLL_BITS, deviations: float = 4.0) -> float:
    """Relative error that an estimate exceeds once in many thousand times."""
    return deviations * 1.04 / (2 ** lg_config_k) ** 0.5


def rank_error(k: int = KLL_K) -> float:
    return 2.3 / k ** 0.9 * 1.5


def sketch_report(commits: DataFrame, events: DataFrame) -> DataFrame:
    """Per week: exact rows and authors, and whether the merged daily sketches keep their error bounds."""
    joined = events.select("event_id", "value").join(commits.select(F.col("commit_id").alias("event_id"), "committed_at",
                                                                    "author"), "event_id")
    week = F.trunc("day", "week")
    merged = merge_sketches(daily_sketches(joined, "committed_at", "author", "value"), week)
    exact = joined.withColumn("day", F.col("committed_at").cast("date")).groupBy(week.alias("period")).agg(
        F.count_distinct("author").alias("authors"))
    half = joined.withColumn("period", F.trunc(F.col("committed_at").cast("date"), "week")).join(
        merged.select("period", "q50"), "period").groupBy("period").agg(
        (F.count_if(F.col("value") <= F.col("q50")) / F.count("value")).alias("upto"),
        (F.count_if(F.col("value") < F.col("q50")) / F.count("value")).alias("below"))
    slack = F.lit(rank_error())
    return merged.join(exact, "period").join(half, "period").select(
        "period", "rows", "authors",
        (F.abs(F.col("distinct_estimate") - F.col("authors")) <= F.greatest(
            F.lit(1.0), F.col("authors") * F.lit(distinct_error()))).alias("authors_within_bound"),
        ((F.col("below") <= 0.5 + slack) & (F.col("upto") >= 0.5 - slack)).alias("median_within_bound"))
