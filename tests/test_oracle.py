"""Every registered query against its DuckDB oracle at sf0.01 (the
driver's correctness gate), and a rows check for the others."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import digest, duck, type_diff  # noqa: E402
from conftest import SF01  # noqa: E402

QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_oracle(spark, con, key):
    df = QUERIES[key](spark, SF01)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(ORACLES[key])
    dcols = [c[0] for c in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert not type_diff(df, con, ORACLES[key])
    assert len(rows) == len(drows)
    assert digest(df.columns, rows) == digest(dcols, drows)


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, key):
    assert QUERIES[key](spark, SF01).count() > 0


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and len(df.columns) > 0
