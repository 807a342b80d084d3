"""Every registered query of the engine against its oracle SQL."""

import pytest

from stratiform import catalog
from tests import oracle

SF = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, db, name):
    oracle.check(catalog.queries()[name](spark, SF), db.sql(SQL[name]))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
