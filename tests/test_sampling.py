from hypothesis import given, settings
from hypothesis import strategies as st

from crashgrid.operators.sampling import capped_sample, categorical_sort, distinct_values, preview, top_n


def frame(spark, n_fatal, n_other):
    rows = [(f"F{i}", "Fatal") for i in range(n_fatal)] + [(f"O{i}", "Injury") for i in range(n_other)]
    return spark.createDataFrame(rows, "EVENT_UNIQUE_ID string, severity_class string")


def test_keeps_everything_under_cap(spark):
    assert capped_sample(frame(spark, 3, 10), cap=20).count() == 13


def test_cap_size_and_protected_rows(spark):
    out = capped_sample(frame(spark, 30, 500), cap=100).collect()
    assert len(out) == 100
    assert sum(1 for r in out if r["severity_class"] == "Fatal") == 30


def test_protected_rows_beyond_cap_all_kept(spark):
    out = capped_sample(frame(spark, 50, 40), cap=20).collect()
    assert len(out) == 50 and all(r["severity_class"] == "Fatal" for r in out)


def test_sample_is_deterministic(spark):
    df = frame(spark, 5, 300)
    a = sorted(r[0] for r in capped_sample(df, cap=50).collect())
    b = sorted(r[0] for r in capped_sample(df.repartition(7), cap=50).collect())
    assert a == b


def test_sample_keeps_rows_without_id(spark, tmp_path):
    frame(spark, 10, 400).unionByName(spark.createDataFrame(
        [(None, "Injury")] * 3, "EVENT_UNIQUE_ID string, severity_class string")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    sample = capped_sample(df, cap=1000)
    assert sample.count() == 413
    small = capped_sample(df, cap=57).collect()
    assert len(small) == 57 and sum(r["severity_class"] == "Fatal" for r in small) == 10


@settings(max_examples=8, deadline=None)
@given(n_fatal=st.integers(0, 40), n_other=st.integers(0, 80), cap=st.integers(1, 60))
def test_sample_contract(spark, n_fatal, n_other, cap):
    out = capped_sample(frame(spark, n_fatal, n_other), cap=cap).collect()
    fatal = sum(1 for r in out if r["severity_class"] == "Fatal")
    assert fatal == n_fatal
    assert len(out) - fatal == min(n_other, max(cap - n_fatal, 0))
    assert len({r[0] for r in out}) == len(out)


def test_top_n_and_sorts(spark):
    df = spark.createDataFrame([(v,) for v in "AABCCCD"], "k string")
    assert [r[0] for r in top_n(df, "k", 2).collect()] == ["C", "A"]
    counts = spark.createDataFrame([("Other", 5), ("Fatal", 1), ("Injury", 3)], "severity_class string, n int")
    order = [r[0] for r in categorical_sort(counts, "severity_class",
                                            ["Fatal", "Injury", "Property Damage", "Other"]).collect()]
    assert order == ["Fatal", "Injury", "Other"]
    assert [r[0] for r in distinct_values(df, "k").collect()] == ["A", "B", "C", "D"]
    assert preview(df, 3, order_by=["k"]).count() == 3


def test_a_boundary_full_of_rows_without_id_is_filled_exactly(spark):
    rows = [(None, "Injury", i) for i in range(400)] + [(f"F{i}", "Fatal", i) for i in range(5)]
    df = spark.createDataFrame(rows, "EVENT_UNIQUE_ID string, severity_class string, n int")
    out = capped_sample(df, cap=55).collect()
    assert len(out) == 55 and len({r["n"] for r in out if r["severity_class"] == "Injury"}) == 50
    again = capped_sample(df.repartition(9), cap=55).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
