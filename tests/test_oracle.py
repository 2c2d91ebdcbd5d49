"""Every core query with SQL, on whole tables, against DuckDB; every other one runs."""

import pytest
from comparing import DATA, same, views

import scriptorium.plans.queries  # noqa: F401
from scriptorium.plans.registry import QUERIES, SQL

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    return views()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    same(QUERIES[name](spark, str(DATA)), duck.execute(SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    rows = QUERIES[name](spark, str(DATA)).collect()
    assert rows and len({tuple(map(repr, r)) for r in rows}) > len(rows) // 2
