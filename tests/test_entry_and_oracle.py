"""Every registered query against its DuckDB oracle (smallest tables by default;
set CRASHGRID_ORACLE_SF_DIR to check another scale)."""

import os

import pytest

import __spark_entry__ as entry
from oracle_check import compare
from data_paths import SF_SMALL


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["OCC_HOUR", "collision_count"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    corpus = {k for k in entry.queries() if k == "pipeline" or k.startswith("op")}  # tested with their own folder
    missing = set(entry.queries()) - corpus - set(entry.oracle_sql())
    assert missing == set()


@pytest.mark.parametrize("key", sorted(entry.queries()))
def test_query_matches_oracle(spark, key):
    status = compare(spark, os.environ.get("CRASHGRID_ORACLE_SF_DIR", SF_SMALL), [key], verbose=True)[key]
    assert status[0] in ("match", "rows-only"), status
