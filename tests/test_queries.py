"""Every registered query of the library against its SQL, or at least its rows and columns."""

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, same

LIBRARY = entry.registry.QUERIES
ORACLE = entry.registry.ORACLE_SQL


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, sf_dir, db, name):
    same(db, ORACLE[name], LIBRARY[name](spark, sf_dir))


@pytest.mark.parametrize("name", sorted(set(LIBRARY) - set(ORACLE)))
def test_has_rows(spark, sf_dir, name):
    df = LIBRARY[name](spark, sf_dir)
    assert df.columns and df.count()


def test_entry_has_rows(spark):
    assert entry.entry(spark).count()


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
