import numpy as np
import pytest
from crashgrid.llm.neighbours import nearest, quantise, search_tile, tile_bounds
from plan_util import plan_text

rng = np.random.default_rng(4)


def brute(rows, queries, k):
    clean = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        clean[i] = min(clean.get(i, v), v)
    out = []
    for q in queries:
        if q in clean:
            scored = []
            for c, v in clean.items():
                if c != q and len(v) == len(clean[q]):
                    total = 0.0
                    for x, y in zip(clean[q], v, strict=True):
                        total += x * y
                    scored.append((-total, c))
            out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def test_bounds_hold_and_are_tight():
    q, c = rng.normal(size=(40, 64)), rng.normal(size=(200, 64)) * rng.uniform(0.01, 50, size=(200, 1))
    low, high = tile_bounds(quantise(q), quantise(c))
    true = q @ c.T
    assert (low <= true).all() and (true <= high).all()
    assert np.median((high - low) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(c, axis=1))) < 0.05


@pytest.mark.parametrize("bounds", [{}, {"block_rows": 16, "stripe_blocks": 2}, {"block_bytes": 300, "stripe_blocks": 3}])
def test_equals_brute_force(spark, bounds):
    vectors = rng.normal(size=(300, 8)).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(400 + i, rows[i][1]) for i in range(60)]  # ties
    rows += [(500, None), (501, []), (502, [0.0] * 8), (503, [float("nan")] * 8), (504, [float("inf")] + [1.0] * 7),
             (505, [None] + [1.0] * 7), (None, [1.0] * 8), (506, [1.0, 2.0]), (508, [2.0, -1.0]), (20, rows[20][1]),
             (507, [1e-30] * 8)]
    frame = spark.createDataFrame([(i, v, 1.0, -1) for i, v in rows],
                                  "vec_id long, embedding array<float>, score double, rank int")
    rows = [(i, v and [float(np.float32(x)) if x is not None else None for x in v]) for i, v in rows]
    got = nearest(frame, frame.where("vec_id % 20 = 0 or vec_id in (506, 507)"), **bounds).collect()
    want = brute(rows, [i for i in dict.fromkeys(i for i, _ in rows) if i is not None and (i % 20 == 0 or i in (506, 507))], 20)
    assert sorted(tuple(r) for r in got) == want


def test_few_candidates_and_empty(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in nearest(frame, frame.where("vec_id = 0")).collect()] == [(0, 1, 1, 2.0)]
    assert nearest(frame.limit(0), frame).count() == 0
    assert nearest(frame, frame.limit(0)).count() == 0


def test_heaps_keep_the_best_over_tiles():
    q, c = rng.normal(size=(3, 16)), rng.normal(size=(500, 16))
    heaps = {}
    for lo in range(0, 500, 100):
        search_tile(heaps, np.arange(3) - 10, q, np.arange(lo, lo + 100), c[lo:lo + 100], 5)
    for i in range(3):
        best = np.argsort(-(c @ q[i]), kind="stable")[:5]
        assert sorted(-v for _, v in heaps[i - 10]) == sorted(best.tolist())


def test_very_wide_vectors_have_small_blocks(spark):
    vectors = rng.normal(size=(12, 20_000))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest(frame, frame.where("vec_id % 5 = 0"), k=3, block_bytes=1 << 18).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, [0, 5, 10], 3)


def test_tasks_are_tiles_bounded_on_both_sides(spark):
    frame = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 400)], "vec_id long, embedding array<double>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_text(nearest(frame, frame.where("vec_id % 2 = 0"), block_rows=20, stripe_blocks=4), "simple")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    join = next(line for line in plan.splitlines() if "SortMergeJoin" in line)  # the join that feeds the search
    assert all(join.count(key) == 2 for key in ("width#", "block#", "stripe#"))
    assert "Cartesian" not in plan and "NestedLoop" not in plan
