"""Every catalogued query against its SQL, or at least that it gives rows."""

import os

import pytest

from longwatch.registry import ORACLE, QUERIES
from tests.oracle import DATA, rows, views

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLE:
        want = views().sql(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)
