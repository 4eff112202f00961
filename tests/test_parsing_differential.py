"""Random dirty texts: Spark's lenient parsers and the oracle SQL must agree."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from crashgrid.functions.coerce import round_half_even, to_number, to_timestamp_any
from crashgrid.plans.oracle import num, ts

PIECES = ["", " ", "\t", "+", "-", "0", "7", "12", "003", ".", ".5", "5.", "e", "E3", "e-2", "d", "f", "x",
          "nan", "inf", "1,5", "1_000", "N/A", "  8  "]


def random_numbers(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 4))) for _ in range(n)]


def random_dates(n, seed):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        d = dt.datetime(2000, 1, 1) + dt.timedelta(days=rnd.randint(0, 9000), seconds=rnd.randint(0, 86399))
        form = rnd.randint(0, 9)
        if form == 0:
            out.append(d.strftime("%Y-%m-%d"))
        elif form == 1:
            out.append(d.strftime("%Y-%m-%d %H:%M:%S"))
        elif form == 2:
            out.append(d.strftime("%Y-%m-%dT%H:%M:%S"))
        elif form == 3:
            out.append(f"{d.month}/{d.day}/{d.year} {d.hour % 12 or 12}:{d.minute:02d}:{d.second:02d} "
                       f"{'AM' if d.hour < 12 else 'PM'}")
        elif form == 4:
            out.append(f"{d.month}/{d.day}/{d.year}")
        elif form == 5:
            out.append(" " + d.strftime("%Y-%m-%d") + " ")
        elif form == 6:
            out.append(d.strftime("%Y-%m-%d")[:-1])            # truncated
        elif form == 7:
            out.append(d.strftime("%d.%m.%Y"))                 # unsupported layout
        elif form == 8:
            out.append(rnd.choice(["not-a-date", "", "2024-13-01", "2024-02-30", "0/0/2020",
                                   d.strftime("%m/%d/%Y %I:%M:%S %p"), d.strftime("%m/%d/%Y %I:%M:%S %p").lower(),
                                   f"{d.year}-{d.month}-{d.day} {d.hour}:{d.minute}:{d.second}"]))
        else:
            out.append(None)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_number_parsing_matches_oracle(spark, seed):
    values = random_numbers(400, seed)
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string")
           .select(to_number(F.col("x"))).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INTEGER, x VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(values)))
    want = [r[0] for r in con.execute(f"SELECT {num('x')} FROM t ORDER BY i").fetchall()]
    assert got == want


@pytest.mark.parametrize("seed", [3, 4, 5, 6])
def test_timestamp_parsing_matches_oracle(spark, seed):
    values = random_dates(400, seed)
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "d string")
           .select(to_timestamp_any(F.col("d"))).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INTEGER, d VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(values)))
    want = [r[0] for r in con.execute(f"SELECT {ts('d')} FROM t ORDER BY i").fetchall()]
    mismatches = [(v, g, w) for v, g, w in zip(values, got, want) if g != w]
    assert not mismatches, mismatches[:5]


def test_half_even_rounding_matches_oracle(spark):
    rnd = random.Random(9)
    values = [round(rnd.uniform(-80, 80), rnd.randint(3, 7)) for _ in range(400)] + [43.6425, 43.6435, -79.2835]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double")
           .select(round_half_even(F.col("x"), 3)).collect()]
    con = duckdb.connect()
    want = [con.execute("SELECT round_even(? * 1000, 0) / 1000", [v]).fetchone()[0] for v in values]
    assert got == want


TEXT_PIECES = ["", " ", "\t", "\n", "\r", "\x0b", "nsa", "NSA", "Unknown", "n/a", "N/A", "none", "NONE",
               "Main St", "yes", "YES", "No", "N/R", "(7)"]


@pytest.mark.parametrize("seed", [7, 8])
def test_text_normalisation_matches_oracle(spark, seed):
    from crashgrid.functions.text import norm_flag
    from crashgrid.operators.cleaning import placeholder_to_null
    from crashgrid.plans.oracle import flag, placeholder
    rnd = random.Random(seed)
    values = [None if rnd.random() < 0.05 else "".join(rnd.choice(TEXT_PIECES) for _ in range(rnd.randint(1, 3)))
              for _ in range(400)]
    got = [(r[0], r[1]) for r in spark.createDataFrame([(v,) for v in values], "x string")
           .select(placeholder_to_null("x"), norm_flag("x")).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INTEGER, x VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(values)))
    want = [(r[0], r[1]) for r in con.execute(f"SELECT {placeholder('x')}, {flag('x')} FROM t ORDER BY i").fetchall()]
    assert got == want
