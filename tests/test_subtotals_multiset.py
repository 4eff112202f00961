import random
from collections import Counter
from itertools import combinations

from crashgrid.operators.multiset import multiset_compare, multiset_intersect, unequal_buckets
from crashgrid.operators.sketches import daily_sketches, distinct_error, merge_sketches, rank_error
from crashgrid.operators.subtotals import cube_counts, grouping_set_counts, rollup_counts
from plan_util import plan_text
from pyspark.sql import functions as F

DIMS = ["a", "b", "c"]


def table(spark, seed=1, n=200):
    rng = random.Random(seed)
    rows = [(rng.choice(["x", "y", None]), rng.choice([1, None]), rng.choice(["p", "q"])) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "a string, b int, c string")


def expected(rows, sets):
    out = Counter()
    for s in sets:
        for r in rows:
            out[tuple(r[i] if i in s else None for i in range(3)) + tuple(i not in s for i in range(3))] += 1
    return out


def found(df):
    assert df.columns == ["a", "b", "c", "all_a", "all_b", "all_c", "grouping_id", "collision_count"]
    rows = df.collect()
    assert all(r["grouping_id"] == 4 * r["all_a"] + 2 * r["all_b"] + r["all_c"] for r in rows)
    got = {tuple(r)[:6]: r["collision_count"] for r in rows}
    assert len(got) == len(rows)
    return got


def test_subtotals_are_told_from_null_keys(spark):
    rows, df = table(spark)
    every = [set(s) for n in range(4) for s in combinations(range(3), n)]
    assert found(cube_counts(df, DIMS)) == expected(rows, every)
    assert found(rollup_counts(df, DIMS)) == expected(rows, [set(), {0}, {0, 1}, {0, 1, 2}])
    assert found(grouping_set_counts(df, [["a", "b"], ["c"]], DIMS)) == expected(rows, [{0, 1}, {2}])


def test_cube_of_an_empty_table_and_its_plan(spark):
    _, df = table(spark, n=0)
    assert all(r["collision_count"] == 0 for r in cube_counts(df, DIMS).collect())
    plan = plan_text(cube_counts(table(spark)[1], DIMS), "simple")
    assert plan.count("Exchange") == 1 and "Expand" in plan and "partial_count" in plan


def test_multisets_equal_brute_force(spark):
    (one, f), (two, s) = table(spark, 2, 300), table(spark, 3, 300)
    extra = [("only", 5, "p")] * 7 + [(None, None, None)] * 2
    f, one = f.union(spark.createDataFrame(extra, f.schema)), one + extra
    left, right = Counter(one), Counter(two)
    for buckets in (1, 3, 4096):
        got = {tuple(r)[:3]: (r["first_rows"], r["second_rows"], r["surplus"])
               for r in multiset_compare(f, s, DIMS, buckets).collect()}
        assert got == {k: (left[k], right[k], left[k] - right[k]) for k in left | right if left[k] != right[k]}
    common = {tuple(r)[:3]: r["common"] for r in multiset_intersect(f, s, DIMS).collect()}
    assert common == dict(left & right)


def test_equal_multisets_open_no_bucket(spark):
    _, df = table(spark)
    shuffled = df.orderBy(F.rand(1))
    assert unequal_buckets(df, shuffled, DIMS).count() == 0
    assert multiset_compare(df, shuffled, DIMS).count() == 0
    assert unequal_buckets(df, df.limit(199), DIMS).count() == 1
    assert multiset_compare(df.limit(0), df.limit(0), DIMS).count() == 0
    assert multiset_intersect(df.limit(0), df, DIMS).count() == 0


def test_merged_daily_sketches_keep_their_bounds(spark):
    rng = random.Random(9)
    rows = [(f"2024-01-{1 + i % 28:02d} 10:00:00", f"u{rng.randrange(5000)}", rng.gauss(0, 1)) for i in range(30_000)]
    events = spark.createDataFrame(rows + [("2024-01-03 00:00:00", None, None)], "ts string, who string, v double")
    daily = daily_sketches(events, "ts", "who", "v")
    assert daily.count() == 28
    whole = merge_sketches(daily, F.trunc("day", "month")).first()
    exact = len({r[1] for r in rows})
    assert whole["rows"] == 30_001 and abs(whole["distinct_estimate"] - exact) <= exact * distinct_error()
    ranked = sorted(r[2] for r in rows)
    for q, name in ((0.5, "q50"), (0.9, "q90")):
        place = sum(v <= whole[name] for v in ranked) / len(ranked)
        assert abs(place - q) <= rank_error()
    part = merge_sketches(daily.filter("day < '2024-01-08'"), F.lit("week")).first()
    assert abs(part["distinct_estimate"] - len({r[1] for r in rows if r[0] < "2024-01-08"})) <= 5000 * distinct_error()
