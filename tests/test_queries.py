"""Every registered query against its oracle SQL on the smallest tables,
plus the driver entry point."""

import pytest

import __spark_entry__ as E
from folioscope.plans.compare import duck, norm
from folioscope.plans.oracle import ORACLE
from folioscope.plans.queries import QUERIES

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["name", "document_count", "description"]
    assert df.count() >= 0


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    want = con.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert norm(got) == norm(want)
