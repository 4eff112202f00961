"""Row-level comparison of two tables as multisets, by hash buckets."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import require_columns

BUCKETS = 4096


def _bucketed(df: DataFrame, columns: Sequence[str], buckets: int) -> DataFrame:
    return df.select(*columns).withColumn("_h", F.xxhash64(*columns)).withColumn(
        "_b", F.pmod(F.xxhash64("_h"), F.lit(int(buckets))).cast("int"))


def unequal_buckets(first: DataFrame, second: DataFrame, columns: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """Hash buckets whose row counts or hash sums differ: one small row per bucket and side is compared."""
    def summary(df: DataFrame, sign: int) -> DataFrame:
        return _bucketed(df, columns, buckets).groupBy("_b").agg(
            (F.lit(sign) * F.count(F.lit(1))).alias("n"), (F.lit(sign) * F.sum(F.col("_h").cast("decimal(38,0)"))).alias("s"))

    return summary(first, 1).unionByName(summary(second, -1)).groupBy("_b").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s")).filter((F.col("n") != 0) | (F.col("s") != 0)).select("_b")


def multiset_compare(first: DataFrame, second: DataFrame, columns: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """Rows that the two tables do not hold equally often: the columns, first_rows, second_rows and surplus.

    Buckets of equal count and hash sum are taken as equal (64-bit hashes);
    only the rows of the others are shuffled and counted. Nulls compare
    equal. Copies are combined inside the tasks, so a row that is a third of a
    table is shuffled as one row per task. ``surplus`` is first less second:
    positive rows are the multiset difference first - second, and the negated
    negative ones second - first.
    """
    columns = list(columns)
    require_columns(first, columns)
    require_columns(second, columns)
    second = second.select(*[F.col(c).cast(first.schema[c].dataType).alias(c) for c in columns])
    open_buckets = unequal_buckets(first, second, columns, buckets)

    def rows(df: DataFrame, side: str) -> DataFrame:
        kept = _bucketed(df, columns, buckets).join(F.broadcast(open_buckets), "_b", "left_semi")  # at most BUCKETS numbers
        other = "second_rows" if side == "first_rows" else "first_rows"
        return kept.select(*columns, F.lit(1).cast("bigint").alias(side), F.lit(0).cast("bigint").alias(other)) \
            .select(*columns, "first_rows", "second_rows")

    counts = rows(first, "first_rows").unionByName(rows(second, "second_rows")).groupBy(*columns).agg(
        F.sum("first_rows").alias("first_rows"), F.sum("second_rows").alias("second_rows"))
    return counts.withColumn("surplus", F.col("first_rows") - F.col("second_rows")).filter(F.col("surplus") != 0)


def multiset_intersect(first: DataFrame, second: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that both tables hold, with ``common``: how often both do. Nulls compare equal."""
    columns = list(columns)
    counted = [df.select(*[F.col(c).cast(first.schema[c].dataType).alias(c) for c in columns]).groupBy(*columns).agg(
        F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(side)) for side, df in enumerate((first, second))]
    both = counted[0].unionByName(counted[1]).groupBy(*columns).agg(
        F.min("n").alias("common"), F.count(F.lit(1)).alias("sides"))
    return both.filter(F.col("sides") == 2).drop("sides")
