"""The training-data queries that SQL can express agree with it; all of them run."""

import pytest

from actlens.llm import queries
from tests.parity import assert_same, connection


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(name, spark, data):
    assert_same(queries.queries()[name](spark, data), connection(data), queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_runs(name, spark, data):
    rows = queries.queries()[name](spark, data)
    assert rows.columns
    rows.write.mode("overwrite").format("noop").save()
