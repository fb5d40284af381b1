"""Every query that has SQL agrees with it; those without run."""

import pytest

from actlens import catalog
from tests.parity import assert_same, connection

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def db(data):
    return connection(data)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(name, spark, data, db):
    assert_same(QUERIES[name](spark, data), db, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(name, spark, data):
    QUERIES[name](spark, data).write.mode("overwrite").format("noop").save()


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
