"""Every registered query against its SQL on the smallest tables."""

import pytest

from glosswork.catalog.oracle import ORACLE
from glosswork.catalog.queries import QUERIES
from tests.compare import difference, oracle_connection

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    return oracle_connection(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, sql, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = sql.execute(ORACLE[name]).df()
    assert len(got) > 0
    assert difference(got, want) is None
