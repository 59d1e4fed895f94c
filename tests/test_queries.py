"""Every registered query of the package against its SQL, on the smallest tables."""

import pytest

from streetweave.plans.catalogue import ORACLES, QUERIES
from tests.oracle import connect, rows_of, rows_of_sql

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    names, rows = rows_of(QUERIES[name](spark, FOLDER))
    assert (names, rows) == rows_of_sql(con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_a_stable_schema(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.columns and len(set(df.columns)) == len(df.columns)
    df.count()
