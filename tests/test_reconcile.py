import random
from collections import Counter

from crashgrid.operators.reconcile import metric_table


def test_top_neighbourhoods_exact_with_many_names_and_ties(spark):
    rnd = random.Random(5)
    names = [f"N{i:04d}" for i in range(800)]
    values = [rnd.choice(names[:40]) if rnd.random() < 0.5 else rnd.choice(names) for _ in range(6000)]
    rows = [(v, float(rnd.randint(0, 23)), "YES" if rnd.random() < 0.1 else "NO") for v in values]
    df = spark.createDataFrame(rows, "NEIGHBOURHOOD_158 string, OCC_HOUR double, PEDESTRIAN string")
    got = {(r["metric"], r["key"]): r["value"] for r in metric_table(df, normalized_road_users=False).collect()}
    counts = Counter(values)
    top = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:10]
    assert sorted(k for (m, k) in got if m == "top_neighbourhood") == sorted(k for k, _ in top)
    assert all(got[("top_neighbourhood", k)] == v for k, v in top)
    hours = Counter(int(r[1]) for r in rows)
    peak = sorted(hours.items(), key=lambda kv: (-kv[1], kv[0]))[0][0]
    assert ("peak_hour", f"{peak:02d}:00") in got
    assert got[("row_count", "")] == 6000
    assert got[("road_user", "Pedestrian")] == sum(1 for r in rows if r[2] == "YES")


def test_metric_table_without_hours_reports_na(spark):
    df = spark.createDataFrame([("A", None)], "NEIGHBOURHOOD_158 string, OCC_HOUR double")
    got = {(r["metric"], r["key"]) for r in metric_table(df, normalized_road_users=True).collect()}
    assert ("peak_hour", "N/A") in got
