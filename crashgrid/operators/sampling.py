"""K1-K5 (sort, top-k, preview, capped sample) and U1/U3 (concat, distinct)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import MAP_SAMPLE_SEED, require_columns
from .aggregates import top_counts


def top_n(df: DataFrame, key: str, n: int) -> DataFrame:
    """K1: the ``n`` most frequent values of ``key`` (count desc, key asc)."""
    require_columns(df, [key])
    return top_counts(df, key, n)


def multi_key_sort(df: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """K2: order by several keys, each 'asc' or 'desc' (nulls last)."""
    cols = [F.col(k).desc_nulls_last() if d == "desc" else F.col(k).asc_nulls_last() for k, d in keys]
    return df.orderBy(*cols)


def category_rank(column: str, categories: Sequence[str]):
    """1-based position of the value in ``categories``; null when not listed."""
    pos = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col(column))
    return F.when(pos > 0, pos)


def categorical_sort(df: DataFrame, column: str, categories: Sequence[str]) -> DataFrame:
    """K3: order rows by a declared category list; unlisted values last."""
    return df.orderBy(category_rank(column, categories).asc_nulls_last(), F.col(column).asc_nulls_last())


def preview(df: DataFrame, n: int = 5, order_by: Sequence | None = None) -> DataFrame:
    """K4: first ``n`` rows, under an explicit order when given (top-k, no full sort)."""
    return (df.orderBy(*order_by) if order_by else df).limit(int(n))


PREFIX_DIGITS = 4  # 65,536 hash groups
EDGE_PARTS = 64  # parts in which the boundary group is ranked first


def capped_sample(df: DataFrame, cap: int, seed: int = MAP_SAMPLE_SEED,
                  protected_class: str = "Fatal", id_col: str = "EVENT_UNIQUE_ID") -> DataFrame:
    """K5: at most ``cap`` rows for display, never dropping a protected row.

    Every row of ``protected_class`` is kept; the others fill the remaining
    ``max(cap - protected, 0)`` places. Which others are kept is fixed by a
    seeded hash order on the row id (md5 of "seed:id", ties by id), so the
    sample is reproducible, identical in any engine with md5, and survives
    task retries. When the input has no more than ``cap`` rows, all are kept.

    Scale: the input is read twice. One aggregate counts rows per hash prefix
    (at most 65,537 groups); a running sum over those counts finds the prefix
    in which the places run out. The second read keeps protected rows and all
    prefixes before that one, and ranks only the rows inside it, in two
    levels: the first ``places`` rows of each of 64 parts dealt by content,
    then those of all parts together. So a prefix that holds a third of all
    rows (rows without an id share one) is ranked by many tasks; rows equal in
    hash and id are told apart by content. The bounds are one scalar
    subquery; the plan stays lazy.
    """
    require_columns(df, ["severity_class", id_col])
    is_protected = F.coalesce(F.col("severity_class") == F.lit(protected_class), F.lit(False))
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    prefix = F.when(~is_protected, F.substring(h, 1, PREFIX_DIGITS))   # null: protected

    running = Window.orderBy(F.col("_p").asc_nulls_first())   # over the prefix counts only
    groups = (df.groupBy(prefix.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
              .withColumns({"_upto": F.sum("_n").over(running),
                            "_protected": F.sum(F.when(F.col("_p").isNull(), F.col("_n"))).over(running)})
              .withColumn("_target", F.greatest(F.lit(int(cap)), F.coalesce("_protected", F.lit(0)))))
    before = F.col("_upto") - F.col("_n")
    whole = F.col("_p").isNotNull() & (F.col("_upto") <= F.col("_target"))
    cut = F.col("_p").isNotNull() & (before < F.col("_target")) & (F.col("_upto") > F.col("_target"))
    bounds = groups.select(F.struct(F.max(F.when(whole, F.col("_p"))).alias("whole"),
                                    F.max(F.when(cut, F.col("_p"))).alias("edge"),
                                    F.max(F.when(cut, F.col("_target") - before)).alias("places"))).scalar()

    in_edge = F.coalesce(prefix == bounds.getField("edge"), F.lit(False))
    kept = df.filter(is_protected | F.coalesce(prefix <= bounds.getField("whole"), F.lit(False)) | in_edge)
    content = F.xxhash64(*df.columns)
    spread = F.lit(EDGE_PARTS) + F.pmod(content, F.lit(1 << 20))   # rows that need no rank
    placed = kept.withColumns({"_sample_hash": h, "_sample_edge": in_edge, "_sample_content": content}).withColumn(
        "_sample_part", F.when(F.col("_sample_edge"), F.pmod("_sample_content", F.lit(EDGE_PARTS))).otherwise(spread))
    order = ["_sample_hash", id_col, "_sample_content"]
    enough = ~F.col("_sample_edge") | (F.col("_sample_rank") <= bounds.getField("places"))
    for part in (F.col("_sample_part"), F.when(F.col("_sample_edge"), F.lit(0)).otherwise(F.col("_sample_part"))):
        rank = F.row_number().over(Window.partitionBy(part).orderBy(*order))
        placed = placed.withColumn("_sample_rank", rank).filter(enough)
    return placed.select(*df.columns)


def concat_rows(first: DataFrame, second: DataFrame) -> DataFrame:
    """Row concatenation by column name, duplicates kept."""
    return first.unionByName(second)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-null values of one column."""
    require_columns(df, [column])
    return df.select(column).dropna().distinct().orderBy(column)
