"""Every registered query equals its DuckDB oracle at sf0.001 (order-insensitive)."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tools.oracle_check import canon, duck_con

ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck_con(SF_SMALL)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_oracle(spark, con, key):
    got = E.queries()[key](spark, SF_SMALL).toPandas()
    want = con.execute(ORACLE[key]).df()
    assert canon(got) == canon(want)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "rank_position" in df.columns
