"""Every registered query against its SQL statement on the smallest test tables."""

import pytest

import __spark_entry__ as entry
from learnmart import catalog
from tools.check_oracle import compare, connect

QUERIES = sorted(catalog.all_queries())


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_a_statement():
    assert set(catalog.all_statements()) == set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, sf_dir, name):
    verdict = compare(spark, con, name, sf_dir)
    assert verdict.startswith("ok"), verdict


def test_entry(spark):
    assert entry.entry(spark).count() > 0
