"""Every query against its reference SQL on the smallest data set."""

from __future__ import annotations

from pathlib import Path

import pytest

from casefile.plans.catalog import load
from compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES = load().queries


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    query = QUERIES[name]
    frame = query.run(spark, FOLDER).toPandas()
    if query.sql is not None:
        assert compare(frame, connection.execute(query.sql).fetchdf()) is None
