"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest
from oracle import compare, connect

from idloom.plans import flows, records, scalars, tables

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = {**scalars.QUERIES, **tables.QUERIES, **records.QUERIES, **flows.QUERIES}, {**scalars.SQL, **tables.SQL, **records.SQL, **flows.SQL}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], SQL[name], SF) is None
