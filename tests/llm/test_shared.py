import pytest
from crashgrid.llm.shared import BATCH_BYTES, BATCH_ROWS, bound_batches, byte_size, free_name

KEYS = {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES, "spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS}


@pytest.mark.parametrize("setting,size", [("64m", 64 << 20), ("1g", 1 << 30), ("67108864b", 64 << 20), ("-1", -1), ("-1b", -1),
                                          ("10000", 10_000), ("2 GB", 2 << 30), ("3kib", 3 << 10)])
def test_sizes_as_spark_writes_them(setting, size):
    assert byte_size(setting) == size


def test_batches_are_bounded_and_smaller_settings_stay(spark):
    before = {k: spark.conf.get(k) for k in KEYS}
    try:
        for k, wide in zip(KEYS, ("1g", "-1"), strict=True):  # rows: -1 is no bound
            spark.conf.set(k, wide)
        bound_batches(spark)
        assert {k: byte_size(spark.conf.get(k)) for k in KEYS} == KEYS
        for k in KEYS:
            spark.conf.set(k, "100")
        bound_batches(spark)
        assert {spark.conf.get(k) for k in KEYS} == {"100"}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_free_names(spark):
    assert free_name(spark.createDataFrame([(1, 2)], "Work int, work_ int"), "work") == "work__"
