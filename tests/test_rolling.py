import datetime as dt
import random

import pytest

from crashgrid.operators.rolling import rank_in_month, rolling_means, same_day_last_year
from plan_util import plan_text

DDL = "key string, date date, value bigint"


def series(spark, rows):
    return spark.createDataFrame(rows, DDL)


def day(n):
    return dt.date(2019, 1, 1) + dt.timedelta(days=n)


@pytest.mark.parametrize("stripe", [28, 40, 10_000])
def test_frames_across_stripes_equal_direct_means(spark, stripe):
    rng = random.Random(4)
    days = sorted(rng.sample(range(500), 260))
    rows = [(k, day(n), rng.choice([None, *range(9)])) for k in ("a", "b", None) for n in days]
    got = rolling_means(series(spark, rows), ["key"], stripe_days=stripe).collect()
    assert len(got) == len(rows)
    for r in got:
        for n in (7, 28):
            inside = [v for k, d, v in rows if k == r["key"] and v is not None
                      and 0 <= (r["date"] - d).days < n]
            assert r[f"days_{n}"] == len(inside)
            assert r[f"mean_{n}"] == (pytest.approx(sum(inside) / len(inside)) if inside else None)


def test_null_dates_empty_series_and_bad_stripes(spark):
    got = rolling_means(series(spark, [("a", None, 3), ("a", day(1), 5)]), ["key"]).collect()
    assert sorted((r["date"] is None, r["mean_7"], r["days_7"]) for r in got) == [(False, 5.0, 1), (True, None, 0)]
    assert rolling_means(series(spark, []), ["key"]).count() == 0
    with pytest.raises(ValueError):
        rolling_means(series(spark, []), ["key"], stripe_days=20)


def test_last_year_with_leap_days(spark):
    rows = [("a", dt.date(2019, 2, 28), 1), ("a", dt.date(2020, 2, 28), 2), ("a", dt.date(2020, 2, 29), 3),
            ("a", dt.date(2021, 2, 28), 4), ("b", dt.date(2021, 2, 28), 5), (None, dt.date(2020, 1, 1), 6),
            (None, dt.date(2021, 1, 1), 7), ("a", None, 8)]
    got = {(r["key"], r["date"]): (r["value"], r["last_year"]) for r in same_day_last_year(series(spark, rows), ["key"]).collect()}
    assert got == {("a", dt.date(2019, 2, 28)): (1, None), ("a", dt.date(2020, 2, 28)): (2, 1),
                   ("a", dt.date(2020, 2, 29)): (3, 1), ("a", dt.date(2021, 2, 28)): (4, 2),
                   ("b", dt.date(2021, 2, 28)): (5, None), (None, dt.date(2020, 1, 1)): (6, None),
                   (None, dt.date(2021, 1, 1)): (7, 6), ("a", None): (8, None)}


def test_ranks_start_anew_each_month(spark):
    rows = [("a", day(0), 4), ("a", day(1), 9), ("a", day(2), 4), ("a", day(3), None), ("a", day(31), 1)]
    got = {r["date"]: (r["month"], r["rank_in_month"]) for r in rank_in_month(series(spark, rows), ["key"]).collect()}
    assert [got[day(n)][1] for n in (0, 1, 2, 3, 31)] == [2, 1, 2, 3, 1]
    assert got[day(31)][0] == dt.date(2019, 2, 1)


def test_one_shuffle_by_key_and_stripe(spark):
    plan = plan_text(rolling_means(series(spark, [("a", day(0), 1)]), ["key"]), "simple")
    assert plan.count("Exchange") == 1 and "_home" in plan.split("Exchange", 1)[1]
    assert plan_text(same_day_last_year(series(spark, [("a", day(0), 1)]), ["key"]), "simple").count("Exchange") == 1
