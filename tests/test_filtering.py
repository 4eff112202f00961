"""Filters against list comprehensions over one random table."""

import datetime as dt
import random

import pytest
from crashgrid.operators import filters as X
from crashgrid.schema import REQUIRED_COLUMNS  # noqa: F401
from plan_util import plan_text

START = dt.datetime(2015, 5, 5)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(12)
    return [dict(n=i, OCC_YEAR=draw.choice([None, 2014, 2015]), YEAR=draw.choice([None, 2014.0, 2015.0]),
                 OCC_HOUR=draw.choice([None, 1, 2, 3]), DIVISION=draw.choice([None, "K", "L"]),
                 NEIGHBOURHOOD_158=draw.choice([None, "P", "Q"]),
                 severity_class=draw.choice(["Fatal", "Injury", "Property Damage", "Other"]),
                 PEDESTRIAN=draw.choice(["YES", "NO"]), BICYCLE=draw.choice(["YES", "NO"]), MOTORCYCLE="NO",
                 OCC_DATE=draw.choice([None, START + dt.timedelta(days=draw.randrange(90), hours=draw.randrange(24))]))
            for i in range(250)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows],
                                 "n int, OCC_YEAR int, YEAR double, OCC_HOUR int, DIVISION string, NEIGHBOURHOOD_158 string, "
                                 "severity_class string, PEDESTRIAN string, BICYCLE string, MOTORCYCLE string, "
                                 "OCC_DATE timestamp_ntz")


def numbers(df):
    return sorted(r["n"] for r in df.collect())


def keep(rows, test):
    return [r["n"] for r in rows if test(r)]


def test_membership_filters_combine(frame, rows):
    for years, hours, divisions in ((None, None, None), ([], [], []), ([2015], None, None), ([2014, 2015], [2], ["K"])):
        want = keep(rows, lambda r: (not years or r["OCC_YEAR"] in years) and (not hours or r["OCC_HOUR"] in hours)
                    and (not divisions or r["DIVISION"] in divisions))
        assert numbers(X.filter_collisions(frame, years=years, hours=hours, divisions=divisions)) == want
    assert numbers(X.filter_by_neighbourhood(frame, "Q", "NEIGHBOURHOOD_158")) == keep(
        rows, lambda r: r["NEIGHBOURHOOD_158"] == "Q")
    with pytest.raises(ValueError, match="Column not found"):
        X.filter_by_neighbourhood(frame, "Q")


def test_severity_and_road_users(frame, rows):
    for name in ("Fatal", "Other"):
        assert numbers(X.apply_collision_severity_filter(frame, name)) == keep(rows, lambda r: r["severity_class"] == name)
    for every in ("All Severities", "no such class"):
        assert numbers(X.apply_collision_severity_filter(frame, every)) == keep(rows, lambda r: True)
    assert numbers(X.apply_road_user_filter(frame, pedestrian=True, bicycle=True)) == keep(
        rows, lambda r: "YES" in (r["PEDESTRIAN"], r["BICYCLE"]))
    assert numbers(X.apply_road_user_filter(frame)) == keep(rows, lambda r: True)


def recent(rows, days):
    dated = [r for r in rows if r["OCC_DATE"]]
    last = max((r["OCC_DATE"] for r in dated), default=None)
    return [r for r in dated if r["OCC_DATE"] >= last - dt.timedelta(days=days)]


def test_recent_window_counts_back_from_the_latest_row_left(frame, rows):
    for days in (1, 20, 1000):
        assert numbers(X.apply_recent_days_filter(frame, days)) == [r["n"] for r in recent(rows, days)]
    fatal = [r for r in rows if r["severity_class"] == "Fatal" and r["YEAR"] == 2014.0]
    got = X.filter_chain(frame, X.DashboardParams(years=(2014,), severity="Fatal", recent_days=10))
    assert numbers(got) == [r["n"] for r in recent(fatal, 10)]
    undated = frame.where("OCC_DATE is null")
    assert X.apply_recent_days_filter(undated, 3).count() == undated.count()


def test_classes_get_their_drawing_order(frame, rows):
    order = ["Injury", "Other", "Fatal"]
    got = {r["n"]: r["draw_order"] for r in X.filter_classes(frame, order).collect()}
    assert sorted(got) == keep(rows, lambda r: r["severity_class"] in order)
    by_class = {rows[n]["severity_class"]: d for n, d in got.items()}
    assert sorted(by_class, key=by_class.get) == order


def test_filters_reach_the_scan(frame, tmp_path, spark):
    frame.write.parquet(str(tmp_path / "t"))
    found = X.filter_collisions_prepared(spark.read.parquet(str(tmp_path / "t")), years=[2014], divisions=["K", "L"])
    plan = plan_text(found.select("n"))
    assert "In(DIVISION, [K,L])" in plan and "EqualTo(YEAR,2014.0)" in plan
