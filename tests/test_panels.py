"""The one-pass count panels equal the single-analysis operators."""

import pytest

from crashgrid.operators import aggregates as A
from crashgrid.plans.panels import count_panels
from crashgrid.plans.prepare import prepare_frame
from crashgrid.sources.fixtures import raw_incidents
from data_paths import SF_SMALL

OPERATORS = {
    "by_hour": A.collisions_by_hour,
    "by_neighbourhood": lambda d: A.collisions_by_neighbourhood(d, 7),
    "by_division": lambda d: A.collisions_by_division(d, 7),
    "severity": A.collision_severity_analysis,
    "road_users": A.road_user_analysis,
    "by_day_of_week": A.collisions_by_day_of_week,
    "by_month": A.collisions_by_month,
    "kpis": A.kpis,
    "peak_hour": lambda d: A.peak_hour(d, empty_label="-"),
}


def _same(a, b):
    assert a.columns == b.columns
    assert a.schema.simpleString() == b.schema.simpleString()
    assert a.collect() == b.collect()      # ordered panels keep the operator's order


@pytest.mark.parametrize("case", ["all", "empty", "one_year"])
def test_panels_match_operators(spark, case):
    df = prepare_frame(raw_incidents(spark, SF_SMALL))
    if case == "empty":
        df = df.filter("1 = 0")
    elif case == "one_year":
        df = df.filter("YEAR = 1997")
    panels = count_panels(df, top_n=7)
    try:
        for name, op in OPERATORS.items():
            _same(panels[name], op(df))
    finally:
        panels["_counts"].unpersist()


def test_panels_with_missing_optional_columns(spark):
    df = spark.createDataFrame([(8, "A"), (8, "B"), (None, "A")], "OCC_HOUR int, NEIGHBOURHOOD_158 string")
    panels = count_panels(df, top_n=5)
    try:
        for name in ("by_hour", "by_division", "by_day_of_week", "by_month", "severity", "road_users", "kpis"):
            op = OPERATORS[name]
            _same(panels[name], op(df))
    finally:
        panels["_counts"].unpersist()
