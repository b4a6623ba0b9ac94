"""Queries over training data: those with SQL give its rows, all run."""

import pytest

from siltstone.llm import catalog
from tests.conftest import plain, rows


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    want = duck.sql(catalog.ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert rows(got, *cols) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, sf_dir, name):
    catalog.QUERIES[name](spark, sf_dir).count()
