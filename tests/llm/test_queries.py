from pathlib import Path

import pytest

from quern.llm import queries
from tests.oracle import assert_same, connect

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, str(FOLDER))
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_agrees_with_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, str(FOLDER)), connect(FOLDER), queries.ORACLE[name])
