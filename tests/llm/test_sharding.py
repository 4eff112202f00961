import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from crashgrid.llm.sharding import _records, bucket_size, shard_manifest, shard_records, task_memory, write_shards
from crashgrid.session import scratch_path

ROWS = [(i, f"text {i} é" * (i % 7)) for i in range(205)] + [(1000, None), (1001, ""), (None, "x"), (3, "same"), (3, "same"),
                                                             (2000, "y" * 200_000)]


@pytest.mark.parametrize("bucket_bytes", [1 << 20, 500])
def test_every_row_once_in_even_gapless_shards(documents, spark, bucket_bytes):
    docs = documents(ROWS)
    out = shard_manifest(docs, scratch_path(spark, "t"), bucket_bytes=bucket_bytes).collect()
    crc = lambda t: zlib.crc32((t or "").encode())
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((i, size(t), crc(t)) for i, t in ROWS)
    counts = Counter(r["shard"] for r in out)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(counts[s]))
    assert {(r["law"], r["grown_shard"]) for r in out} == {("rows", None)}


def test_seed_decides_the_order_and_order_is_mixed(documents):
    docs = documents([(i, f"t{i}") for i in range(400)])
    place = lambda seed: {(r["shard"], r["slot"]): r["record"]["doc_id"] for r in
                          shard_records(docs, seed=seed, bucket_bytes=600).collect()}
    one, again, other = place(1), place(1), place(2)
    assert one == again != other
    order = [one[k] for k in sorted(one)]
    rising = sum(x < y for x, y in zip(order, order[1:], strict=False))
    assert 150 < rising < 250


def test_columns_stay_and_names_do_not_clash(spark):
    docs = spark.createDataFrame([(1, "a", 7, "s")], "doc_id long, text string, shard int, slot string")
    back = write_shards(docs, scratch_path(spark, "t"))
    assert [tuple(r)[:4] for r in back.collect()] == [(1, "a", 7, "s")]


def test_fewer_rows_than_shards_and_none(documents, spark):
    few = shard_records(documents([(1, "a"), (2, "b")])).collect()
    assert sorted((r["shard"], r["slot"]) for r in few) == [(0, 0), (1, 0)]
    assert shard_manifest(documents([]), scratch_path(spark, "t")).count() == 0


def test_no_python_on_the_main_path(documents):
    plan = shard_records(documents(ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_a_row_that_makes_a_third_of_the_table_is_dealt_out(documents, spark):
    rows = [(7, "the same " * 20)] * 3000 + [(None, None)] * 1500 + [(i, f"own text {i} " * 12) for i in range(4500)]
    docs = documents(rows)
    records = _records(docs, 42, "doc_id", "text")
    counts = [r["count"] for r in records.groupBy(F.pmod("h", F.lit(30))).count().collect()]
    assert sum(counts) == 9000 and len(counts) == 30 and max(counts) < 1.5 * 9000 / 30
    out = shard_manifest(docs, scratch_path(spark, "t"), bucket_bytes=50_000).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _ in rows)
    per_shard = Counter(r["shard"] for r in out)
    assert max(per_shard.values()) - min(per_shard.values()) <= 1
    assert all(sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n)) for s, n in per_shard.items())
    same = Counter(r["shard"] for r in out if r["doc_id"] == 7)
    assert max(same.values()) < 1.5 * 3000 / 16  # copies are mixed like other rows


def test_bucket_size_follows_the_task_memory(spark):
    assert 16 << 20 <= bucket_size(spark) <= 512 << 20
    assert bucket_size(spark) == max(16 << 20, min(512 << 20, task_memory(spark) // 16))
    assert task_memory(spark) == (4 << 30) // spark.sparkContext.defaultParallelism


def brute_places(rows, shards, order):
    """The law by hand: records in ``order``, cut into shards of row counts at most one apart."""
    small, extra = divmod(len(rows), shards)
    sizes = [small + (s < extra) for s in range(shards)]
    places = [(s, slot) for s, n in enumerate(sizes) for slot in range(n)]
    return dict(zip(order, places, strict=True))


@pytest.mark.parametrize("n", [5, 16, 205])
def test_shards_are_cuts_of_one_order(documents, n):
    rows = [(i, f"t{i}") for i in range(n)]
    got = {r["record"]["doc_id"]: (r["shard"], r["slot"]) for r in shard_records(documents(rows), bucket_bytes=100).collect()}
    order = sorted(got, key=got.get)
    assert brute_places(rows, 16, order) == got
