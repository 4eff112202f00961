import pytest

from crashgrid.operators import bloom
from crashgrid.operators.bloom import bloom_anti_join, bloom_semi_join, build_filter, filter_size
from plan_util import plan_text
from pyspark.sql import functions as F


def test_no_selected_key_is_lost_and_few_others_pass(spark):
    keys = spark.range(0, 60_000, 3).select(F.concat(F.lit("k"), F.col("id")).alias("k"))
    for rate in (0.01, 0.2):
        built = build_filter(keys, "k", rate)
        assert built.bits % bloom.WORD_BITS == 0
        probed = spark.range(60_000).select("id", F.concat(F.lit("k"), F.col("id")).alias("k")).withColumn(
            "hit", built.might_contain(F.col("k")))
        assert probed.filter("id % 3 = 0 and not hit").isEmpty()
        passed = probed.filter("id % 3 <> 0 and hit").count()
        assert passed <= 2 * rate * 40_000


@pytest.mark.parametrize("limit", [bloom.MAX_FILTER_BYTES, 100])
def test_joins_equal_the_exact_ones(spark, monkeypatch, limit):
    monkeypatch.setattr(bloom, "MAX_FILTER_BYTES", limit)  # the small limit leaves the exact join alone
    rows = [(i % 50, i) for i in range(500)] + [(None, -1)] * 3 + [(7, 5)] * 200
    df = spark.createDataFrame(rows, "k int, n int")
    keys = spark.createDataFrame([(i,) for i in (7, 7, 11, 99)] + [(None,)], "k int")
    semi = sorted(tuple(r) for r in bloom_semi_join(df, keys, "k").collect())
    anti = sorted(map(str, bloom_anti_join(df, keys, "k").collect()))
    assert semi == sorted(r for r in rows if r[0] in (7, 11))
    assert anti == sorted(map(str, spark.createDataFrame([r for r in rows if r[0] not in (7, 11)], df.schema).collect()))
    assert bloom_semi_join(df, keys.limit(0), "k").isEmpty() and bloom_anti_join(df, keys.limit(0), "k").count() == len(rows)


def test_filter_size_follows_the_count():
    assert filter_size(0, 0.01)[0] == bloom.WORD_BITS
    bits, hashes = filter_size(1_000_000, 0.01)
    assert 9.5e6 < bits < 9.7e6 and hashes == 7


def test_filter_stands_below_the_join(spark):
    df, keys = spark.range(1000).toDF("k"), spark.range(10).toDF("k")
    plan = plan_text(bloom_semi_join(df, keys, "k"), "simple")
    assert "Filter" in plan.split("LeftSemi", 1)[1] and "Python" not in plan
