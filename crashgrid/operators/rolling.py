"""Rolling frames over daily series and ranks inside calendar months.

Frames are ranges of days, not rows, so missing days need no filling first.
A series is cut into stripes of days; the days just before a stripe are
carried into it as a border, so each stripe's frames are complete and a long
series is spread over many tasks.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import require_columns


def rolling_means(series: DataFrame, keys: Sequence[str] = (), days: Sequence[int] = (7, 28), date_col: str = "date",
                  value_col: str = "value", stripe_days: int = 366) -> DataFrame:
    """``series`` plus, per frame of n days up to and including the row's: mean_<n> and days_<n> (rows with a value).

    One shuffle on (keys, stripe). ``stripe_days`` must not be shorter than
    the widest frame less a day. Rows with a null date have empty frames.
    """
    require_columns(series, [date_col, value_col, *keys])
    border = max(days) - 1
    if min(days) < 1 or stripe_days < max(border, 1):
        raise ValueError("frames need a day at least and must fit in a stripe")
    day = F.unix_date(F.col(date_col).cast("date"))
    stripe = F.floor(F.col("_day") / F.lit(int(stripe_days)))
    # a row near its stripe's end is the border of the next one
    next_start = (F.col("_stripe") + 1) * F.lit(int(stripe_days))
    homes = F.when(F.col("_day") >= next_start - F.lit(border), F.array(F.col("_stripe"), F.col("_stripe") + 1)) \
        .otherwise(F.array(F.col("_stripe")))
    rows = (series.withColumn("_day", day).withColumn("_stripe", stripe)
            .withColumn("_home", F.explode(homes)))
    out = rows
    for n in days:
        frame = Window.partitionBy(*keys, "_home").orderBy("_day").rangeBetween(-(n - 1), 0)
        present = F.col("_day").isNotNull()
        out = out.withColumns({f"mean_{n}": F.when(present, F.avg(F.col(value_col).cast("double")).over(frame)),
                               f"days_{n}": F.when(present, F.count(value_col).over(frame)).otherwise(0)})
    own = F.col("_home").eqNullSafe(F.col("_stripe"))
    return out.filter(own).drop("_day", "_stripe", "_home")


def same_day_last_year(series: DataFrame, keys: Sequence[str] = (), date_col: str = "date",
                       value_col: str = "value") -> DataFrame:
    """``series`` (one row per key and day) plus last_year: the key's value a year before, null if there is none.

    29 February looks at 28 February. Every row is sent to its own day and to
    the days that look at it, so the series is read once and shuffled once.
    """
    require_columns(series, [date_col, value_col, *keys])
    kind = series.schema[date_col].dataType
    day = F.col(date_col).cast("date")
    next_year = F.add_months(day, 12)
    lookers = F.filter(F.array(next_year, F.date_add(next_year, 1)), lambda t: F.add_months(t, -12) == day)
    entry = lambda own, at, value, before: F.struct(
        own.alias("own"), at.cast(kind).alias("at"), value.alias("value"), before.alias("before"))
    nothing = F.lit(None).cast(series.schema[value_col].dataType)
    sent = F.concat(F.array(entry(F.lit(True), F.col(date_col), F.col(value_col), nothing)),
                    F.transform(F.coalesce(lookers, F.array().cast("array<date>")),
                                lambda t: entry(F.lit(False), t, nothing, F.col(value_col))))
    met = series.select(*keys, F.explode(sent).alias("_e")).groupBy(*keys, F.col("_e.at").alias(date_col)).agg(
        F.max("_e.value").alias(value_col), F.max("_e.before").alias("last_year"), F.max("_e.own").alias("_own"))
    return met.filter("_own").select(*[c for c in series.columns if c in {*keys, date_col, value_col}], "last_year")


def rank_in_month(series: DataFrame, keys: Sequence[str] = (), date_col: str = "date",
                  value_col: str = "value") -> DataFrame:
    """``series`` plus month (its first day) and rank_in_month: dense rank by value, the largest first, per key and month."""
    require_columns(series, [date_col, value_col, *keys])
    month = F.trunc(F.col(date_col).cast("date"), "month")
    frame = Window.partitionBy(*keys, "month").orderBy(F.desc_nulls_last(value_col))
    return series.withColumn("month", month).withColumn("rank_in_month", F.dense_rank().over(frame))
