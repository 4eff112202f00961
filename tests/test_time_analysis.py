"""Weekday and month counts against the calendar module."""

import calendar
import random
from collections import Counter

import pytest
from crashgrid.operators.aggregates import collisions_by_day_of_week, collisions_by_month


@pytest.mark.parametrize("n", [0, 1, 7, 400])
def test_weekdays_follow_the_week(spark, n):
    draw = random.Random(n)
    values = [draw.choice([*calendar.day_name, None]) for _ in range(n)]
    got = collisions_by_day_of_week(spark.createDataFrame([(v,) for v in values], "OCC_DOW string"))
    assert got.columns == ["day_of_week", "collision_count"]
    counts = Counter(values)
    assert [tuple(r) for r in got.collect()] == [(d, counts[d]) for d in calendar.day_name if counts[d]]


@pytest.mark.parametrize("kind", ["int", "double"])
def test_months_follow_the_year(spark, kind):
    draw = random.Random(3)
    values = [draw.choice([*range(1, 13), None]) for _ in range(300)]
    typed = [(v if v is None or kind == "int" else float(v),) for v in values]
    got = collisions_by_month(spark.createDataFrame(typed, f"MONTH {kind}")).collect()
    counts = Counter(values)
    assert [(r["month"], r["month_name"], r["collision_count"]) for r in got] == [
        (m, calendar.month_name[m], counts[m]) for m in range(1, 13)]


def test_labels_off_the_calendar(spark):
    days = spark.createDataFrame([("Someday",), ("Sunday",), ("Someday",)], "OCC_DOW string")
    assert [tuple(r) for r in collisions_by_day_of_week(days).collect()] == [("Sunday", 1), (None, 2)]
    months = spark.createDataFrame([(0,), (5,), (14,)], "MONTH int")
    assert {(r["month"], r["month_name"]) for r in collisions_by_month(months).collect()} == {
        (0, None), (5, "May"), (14, None)}


def test_absent_columns_give_empty_tables(spark):
    other = spark.createDataFrame([(1,)], "z int")
    assert collisions_by_day_of_week(other).count() == 0 == collisions_by_month(other).count()
