import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from crashgrid.session import get_spark
    ckpt = tempfile.mkdtemp(prefix="crashgrid-test-ckpt-")
    s = get_spark("local[4]", app="crashgrid-tests", shuffle_partitions=8,
                  conf={"spark.checkpoint.dir": ckpt, "spark.driver.memory": "4g"})
    yield s
    s.stop()


@pytest.fixture
def frame(spark):
    """Build a small DataFrame from a dict of columns (schema as DDL)."""
    def make(columns: dict, ddl: str):
        names = list(columns)
        n = len(next(iter(columns.values()))) if columns else 0
        rows = [tuple(columns[c][i] for c in names) for i in range(n)]
        return spark.createDataFrame(rows, ddl)
    return make
