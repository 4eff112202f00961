"""Cleaning as properties of random raw tables, and literal expectations per text form."""

import datetime as dt
import random
import re

import pytest
from plan_util import plan_text
from pyspark.sql import functions as F
from crashgrid.functions.coerce import to_timestamp_any
from crashgrid.operators.cleaning import clean, coerce_numeric, coerce_timestamp, dedupe_rows, quality_report
from crashgrid.schema import REQUIRED_COLUMNS

DDL = ", ".join(f"{c} string" for c in REQUIRED_COLUMNS)


def raw_rows(n, seed):
    draw = random.Random(seed)
    def one(i):
        row = dict.fromkeys(REQUIRED_COLUMNS, "NO")
        row |= {"EVENT_UNIQUE_ID": f"ev{i}", "OCC_DATE": draw.choice(["2016-02-29", "7/4/2018", "soon", None]),
                "OCC_YEAR": draw.choice(["2016", None]), "OCC_HOUR": draw.choice(["0", "23", "7.0", "?", None]),
                "LAT_WGS84": draw.choice(["51.5", "0", "x", None]), "LONG_WGS84": draw.choice(["-0.12", "0", None]),
                "NEIGHBOURHOOD_158": draw.choice(["Soho", "NSA", " nsa\u00a0", "", "Kew", None])}
        return tuple(row[c] for c in REQUIRED_COLUMNS)
    rows = [one(i) for i in range(n)]
    return rows + [draw.choice(rows) for _ in range(n // 3)]


@pytest.mark.parametrize("seed", [1, 2])
def test_clean_keeps_each_located_row_once(spark, seed):
    rows = raw_rows(90, seed)
    place = {c: i for i, c in enumerate(REQUIRED_COLUMNS)}
    located = {r for r in rows if r[place["LAT_WGS84"]] == "51.5" and r[place["LONG_WGS84"]] == "-0.12"}
    frame = spark.createDataFrame(rows, DDL)
    got = clean(frame).collect()
    assert sorted(r["EVENT_UNIQUE_ID"] for r in got) == sorted(r[0] for r in located)
    names = {r["NEIGHBOURHOOD_158"] for r in got}
    assert names <= {"Soho", "Kew", None}
    assert all(r["HAS_VALID_COORDINATES"] and r["HAS_VALID_NEIGHBOURHOOD"] == (r["NEIGHBOURHOOD_158"] is not None)
               for r in got)
    assert sorted(dedupe_rows(dedupe_rows(frame)).collect(), key=str) == sorted(dedupe_rows(frame).collect(), key=str)
    report = quality_report(frame).first().asDict()
    assert report["total_rows"] == len(rows) and report["duplicate_rows"] == len(rows) - len(set(rows))


def test_duplicates_are_judged_as_text(spark):
    row = raw_rows(1, 5)[0]
    at = REQUIRED_COLUMNS.index("OCC_HOUR")
    forms = [row[:at] + (h,) + row[at + 1:] for h in ("4", "4.0", "4", "04")]
    assert dedupe_rows(spark.createDataFrame(forms, DDL)).count() == 3


NUMBERS = {"12": 12.0, "-3.5": -3.5, "\t6 ": 6.0, "2e3": 2000.0, ".5": 0.5, "5d": None, "NaN": None, "1,5": None, "": None}


def test_number_texts(spark):
    frame = spark.createDataFrame([(k,) for k in NUMBERS], "OCC_HOUR string").selectExpr(
        "OCC_HOUR", "OCC_HOUR OCC_YEAR", "OCC_HOUR LAT_WGS84", "OCC_HOUR LONG_WGS84")
    for c in frame.columns:
        assert [r[c] for r in coerce_numeric(frame).collect()] == list(NUMBERS.values())


T = dt.datetime
DATES = {"2021-03-09": T(2021, 3, 9), "2021-3-9 4:05:06": T(2021, 3, 9, 4, 5, 6), "2021-03-09T04:05:06": T(2021, 3, 9, 4, 5, 6),
         "3/9/2021 4:05:06 PM": T(2021, 3, 9, 16, 5, 6), "3/9/2021": T(2021, 3, 9), "2021/03/09": T(2021, 3, 9),
         "2021/03/09 04:05:06": T(2021, 3, 9, 4, 5, 6), "2021/03/09 05:00:00+00": T(2021, 3, 9, 5),
         "2021-03-09T05:00:00Z": T(2021, 3, 9, 5), "2021-03-09 05:00": T(2021, 3, 9, 5), "2021-03-09T05:00": T(2021, 3, 9, 5),
         "2021-03-09 05:00:00.123": T(2021, 3, 9, 5, 0, 0, 123000), "2021-03-09T05:00:00.5Z": T(2021, 3, 9, 5, 0, 0, 500000),
         "2021-03-09 05:00:00+00:00": T(2021, 3, 9, 5), "2021-03-09 05:00:00-05:30": T(2021, 3, 9, 10, 30),
         "2021-03-09T05:00+0200": T(2021, 3, 9, 3), "3/9/2021 5:00 AM": T(2021, 3, 9, 5), "3/9/2021 17:00": T(2021, 3, 9, 17),
         "3/9/2021 17:00:09": T(2021, 3, 9, 17, 0, 9), "20210309": T(2021, 3, 9), "Mar 9, 2021": T(2021, 3, 9),
         " 2021-03-09\u00a0": T(2021, 3, 9), "2021-02-30": None, "9.3.2021": None, "yesterday": None, "": None}


def test_timestamp_texts(spark):
    frame = spark.createDataFrame([(k,) for k in DATES], "OCC_DATE string")
    got = dict(zip(DATES, (r["OCC_DATE"] for r in coerce_timestamp(frame).collect()), strict=True))
    assert got == DATES


def test_empty_input(spark):
    frame = spark.createDataFrame([], DDL)
    assert clean(frame).count() == 0 and set(quality_report(frame).first().asDict().values()) == {0}


def test_dates_with_month_names_and_months(spark):
    texts = {"January 15, 2024": dt.datetime(2024, 1, 15), "15 Jan 2024": dt.datetime(2024, 1, 15),
             "Jan 15, 2024": dt.datetime(2024, 1, 15), "3 September 2021": dt.datetime(2021, 9, 3),
             "May 1, 2020": dt.datetime(2020, 5, 1), "1 May 2020": dt.datetime(2020, 5, 1),
             "2024-01": dt.datetime(2024, 1, 1), "2024-13": None, "Janch 3, 2024": None, "Jan 2024": None,
             "15 Jan 15, 2024": None, "Foo 3, 2024": None, "31 Feb 2024": None}
    df = spark.createDataFrame([(t,) for t in texts], "OCC_DATE string")
    got = dict(df.select("OCC_DATE", to_timestamp_any("OCC_DATE").alias("t")).collect())
    assert got == texts


def test_generated_code_of_the_date_parser_stays_small(spark):
    """The text is computed once per row, and no method is too long for the JVM to compile (8000 bytes)."""
    df = spark.range(1).select(F.concat(F.lit("2024-01-"), F.col("id") + 10).alias("t")).select(
        to_timestamp_any("t").alias("at")).filter("at is not null")
    code = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
    assert max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)) < 8000
    assert plan_text(df, "simple").count("trim(") == 2  # one in the filter, one in the result
    assert [str(r["at"]) for r in df.collect()] == ["2024-01-10 00:00:00"]
