"""The operators' queries with SQL against DuckDB on the smallest tables."""

import os

import pytest

from studyloom.llm import registry
from tests.test_queries import SF, db, plain

assert db  # a fixture
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, db, name):  # noqa: F811
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    found = db.execute(ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(repr(tuple(plain(row[i]) for i in at)) for row in found.fetchall())
