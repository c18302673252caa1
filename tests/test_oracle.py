"""Every registered query against its SQL on the smallest data set."""

import pytest

from oracle import compare, connect
from tidelog.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toArrow()
    assert len(set(got.column_names)) == len(got.column_names)
    if name in ORACLES:
        assert compare(got, con.sql(ORACLES[name]).to_arrow_table()) == []
    else:
        assert got.num_rows > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
