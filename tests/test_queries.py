"""Every query with a DuckDB statement agrees with it on the smallest tables."""

from pathlib import Path

import pytest

from quern.plans import problems, reference, roundtrips  # noqa: F401
from tests.oracle import assert_same, connect

FOLDER = Path("/root/testdata/sf0.001")
QUERIES = problems.QUERIES | reference.QUERIES
ORACLE = problems.ORACLE | reference.ORACLE
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_agrees_with_sql(spark, connection, name):
    assert_same(QUERIES[name](spark, str(FOLDER)), connection, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    df = QUERIES[name](spark, str(FOLDER))
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() >= 0


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["q_scan_project_filter"](spark, str(FOLDER))._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan") :]
    assert "GreaterThanOrEqual(l_shipdate" in scan[scan.index("PushedFilters") :]
    assert scan.startswith("FileScan parquet [") and scan[: scan.index("]")].count(",") == 4  # five columns
