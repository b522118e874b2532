"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as registered
from check_twins import compare, database

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return database(FOLDER)


# The corpus operators have tests of their own.
@pytest.mark.parametrize("name", [n for n in registered.queries() if n not in registered.LLM_QUERIES])
def test_query_matches_twin(spark, db, name):
    verdict, rows, _ = compare(spark, db, FOLDER, name)
    assert verdict in ("ok", "rows-only"), verdict
    if verdict == "rows-only":
        assert rows > 0


def test_every_twin_has_a_query():
    assert set(registered.oracle_sql()) <= set(registered.queries())


def test_entry_returns_rows(spark):
    assert registered.entry(spark).count() > 0
