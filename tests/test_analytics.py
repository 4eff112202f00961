"""Aggregates against plain counting over random tables."""

import random
from collections import Counter

import pytest
from crashgrid.operators import aggregates as A

SEVERITIES = ["Fatal", "Injury", "Property Damage", "Other", None]
FLAGS = ["YES", "NO", " yes", "N/R", None, "Yes "]


def table(spark, n, seed):
    draw = random.Random(seed)
    rows = [(draw.choice([None, *range(24)]), draw.choice([None, "Elm", "Oak", "Ash", "10", "9"]),
             draw.choice([None, "X1", "X2"]), draw.choice(SEVERITIES), *(draw.choice(FLAGS) for _ in range(4)),
             draw.choice([None, 2011.0, 2013.0]), draw.uniform(10, 11), draw.uniform(20, 21)) for _ in range(n)]
    frame = spark.createDataFrame(rows, "OCC_HOUR int, NEIGHBOURHOOD_158 string, DIVISION string, severity_class string, "
                                  "PEDESTRIAN string, BICYCLE string, MOTORCYCLE string, AUTOMOBILE string, YEAR double, "
                                  "LAT_WGS84 double, LONG_WGS84 double")
    return frame, rows


def ranked(values, top=None):
    counts = Counter(v for v in values if v is not None)
    return sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:top]


@pytest.mark.parametrize("seed,n", [(1, 0), (2, 1), (3, 300), (4, 300)])
def test_counts_order_and_top_n(spark, seed, n):
    frame, rows = table(spark, n, seed)
    plain = lambda df: [tuple(r)[:2] for r in df.collect()]
    assert plain(A.collisions_by_hour(frame)) == ranked(r[0] for r in rows)
    for top in (1, 2, 50):
        assert plain(A.collisions_by_neighbourhood(frame, top)) == ranked((r[1] for r in rows), top)
    assert plain(A.collisions_by_division(frame)) == ranked(r[2] for r in rows)
    severity = Counter(r[3] for r in rows)
    assert plain(A.collision_severity_analysis(frame)) == [(s, severity[s]) for s in SEVERITIES[:3]]
    exact = {"Pedestrian": 4, "Bicycle": 5, "Motorcycle": 6}
    assert dict(plain(A.road_user_analysis(frame))) == {k: sum(r[i] == "YES" for r in rows) for k, i in exact.items()}
    clean = lambda v: (v or "").strip().upper() == "YES"
    assert dict(plain(A.road_user_summary_normalized(frame))) == {k: sum(clean(r[i]) for r in rows) for k, i in exact.items()}


def test_one_row_summaries(spark):
    frame, rows = table(spark, 200, 8)
    got = A.kpis(frame).first().asDict()
    assert got["total_collisions"] == 200
    assert (got["fatal"], got["injury"]) == (sum(r[3] == "Fatal" for r in rows), sum(r[3] == "Injury" for r in rows))
    best = ranked(r[0] for r in rows)[0][0]
    assert A.peak_hour(frame).first()["peak_hour"] == f"{best:02d}:00"
    assert A.default_year(frame).first()["default_year"] == 2013
    view = A.map_viewport(frame).first()
    assert 10 < view["center_lat"] < 11 and 20 < view["center_lon"] < 21
    assert dict((r[0], r[1]) for r in A.road_user_with_automobile(frame).collect())["Automobile"] >= sum(
        r[7] == "YES" for r in rows)


def test_absent_hours_and_columns(spark):
    blank = spark.createDataFrame([(None,)], "OCC_HOUR int")
    assert A.peak_hour(blank).first()["peak_hour"] == "N/A"
    assert A.peak_hour(blank, empty_label="none").first()["peak_hour"] == "none"
    assert A.collision_severity_analysis(blank).count() == 0 == A.collisions_by_division(blank).count()
    assert {r[1] for r in A.road_user_analysis(blank).collect()} == {0}
    for needed in (A.collisions_by_neighbourhood, lambda df: A.collisions_by_hour(df.drop("OCC_HOUR"))):
        with pytest.raises(ValueError, match="Missing required columns"):
            needed(blank.withColumn("z", blank["OCC_HOUR"]))
