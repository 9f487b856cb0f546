"""Every registered query beside its SQL, on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import compare, connect
from tests.conftest import TINY


@pytest.fixture(scope="module")
def database():
    return connect(TINY)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, database, name):
    assert compare(spark, name, TINY, database).startswith("same")


def test_entry(spark):
    assert entry(spark).count() > 0


def test_keys_agree():
    assert set(oracle_sql()) <= set(queries())
