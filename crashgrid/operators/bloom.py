"""Semi and anti joins that a Bloom filter of the selected keys prunes before the shuffle."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import require_columns

WORD_BITS = 32_768  # bits of one of Spark's bitmaps
MAX_FILTER_BYTES = 32 << 20  # a larger filter is not sent to the tasks


@dataclass(frozen=True)
class BloomFilter:
    """Bitmaps of the keys' hashed positions (one scalar that every task gets), its size and number of hashes."""
    bitmaps: Column
    bits: int
    hashes: int

    def might_contain(self, key: Column) -> Column:
        """False only for keys that are surely not selected; null keys are not."""
        found = key.isNotNull()
        for i in range(self.hashes):
            place = _place(key, i, self.bits)
            word = F.get(self.bitmaps, F.floor(place / F.lit(WORD_BITS)).cast("int"))
            bit = F.pmod(place, F.lit(WORD_BITS))
            byte = F.conv(F.hex(F.substring(word, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            mask = F.element_at(F.array(*(F.lit(1 << b) for b in range(8))), (bit % 8).cast("int") + 1)
            found = found & (byte.bitwiseAND(mask) != 0)
        return found


def _place(key: Column, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits).cast("bigint"))


def filter_size(n_keys: int, false_positives: float) -> tuple[int, int]:
    """(bits, hashes) for ``n_keys`` at the wanted rate of false positives."""
    n = max(1, n_keys)
    bits = math.ceil(-n * math.log(false_positives) / math.log(2) ** 2 / WORD_BITS) * WORD_BITS
    return bits, max(1, round(bits / n * math.log(2))) if n * 20 > bits else 7


def build_filter(keys: DataFrame, column: str, false_positives: float = 0.01) -> BloomFilter | None:
    """Filter of the distinct non-null values of ``column``; None if it would exceed ``MAX_FILTER_BYTES``.

    The keys are counted first (their number decides the size). Each key sets
    its bits in bitmaps that tasks combine before the shuffle.
    """
    selected = keys.select(F.col(column).alias("k")).filter("k is not null").distinct()
    bits, hashes = filter_size(selected.count(), false_positives)
    if bits // 8 > MAX_FILTER_BYTES:
        return None
    places = selected.select(F.explode(F.array(*(_place(F.col("k"), i, bits) + 1 for i in range(hashes)))).alias("p"))
    words = places.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("w"))
    found = words.agg(F.map_from_entries(F.collect_list(F.struct("b", "w"))).alias("m"))
    empty = F.unhex(F.repeat(F.lit("00"), WORD_BITS // 8))
    dense = F.transform(F.sequence(F.lit(1).cast("bigint"), F.lit(bits // WORD_BITS).cast("bigint")),
                        lambda b: F.coalesce(F.try_element_at(F.col("m"), b), empty))
    return BloomFilter(found.select(dense).scalar(), bits, hashes)


def bloom_semi_join(df: DataFrame, keys: DataFrame, column: str, false_positives: float = 0.01) -> DataFrame:
    """Rows of ``df`` whose ``column`` is among ``keys``: the filter drops most others in the scan's task, the exact
    join drops the rest. Without a filter (too many keys) the join alone gives the same rows."""
    require_columns(df, [column])
    bloom = build_filter(keys, column, false_positives)
    pruned = df if bloom is None else df.filter(bloom.might_contain(F.col(column)))
    return pruned.join(keys.select(column), column, "left_semi").select(*df.columns)


def bloom_anti_join(df: DataFrame, keys: DataFrame, column: str, false_positives: float = 0.01) -> DataFrame:
    """Rows of ``df`` whose ``column`` is not among ``keys`` (null is not): those the filter rules out stay where they
    are, only the others are shuffled for the exact join."""
    require_columns(df, [column])
    bloom = build_filter(keys, column, false_positives)
    if bloom is None:
        return df.join(keys.select(column), column, "left_anti").select(*df.columns)
    maybe = bloom.might_contain(F.col(column))
    checked = df.filter(maybe).join(keys.select(column), column, "left_anti").select(*df.columns)
    return df.filter(~maybe).unionByName(checked)
