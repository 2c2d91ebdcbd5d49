"""Queries of the subpackage: those with SQL against DuckDB on whole tables, the others run."""

import pytest
from comparing import DATA, same, views

from scriptorium.llm.queries import QUERIES
from scriptorium.llm.sql import SQL

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    return views()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    same(QUERIES[name](spark, str(DATA)), duck.execute(SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, str(DATA))
    rows = df.collect()
    assert rows and len({tuple(map(repr, r)) for r in rows}) > len(rows) // 2
