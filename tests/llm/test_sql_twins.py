"""Every SQL twin of this package's queries, at sf0.01."""

import os

import duckdb
import pytest
from conftest import SF01

from lectern.llm import queries as Q


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF01):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF01}/{f}'")
    return con


@pytest.mark.parametrize("name", Q.ORACLES)
def test_query_matches_its_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, SF01)
    found = duck.execute(Q.ORACLES[name])
    theirs = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(theirs)

    def listed(rows, names):
        order = sorted(range(len(names)), key=names.__getitem__)
        return sorted(str([r[i] for i in order]) for r in rows)

    rows = listed(df.collect(), df.columns), listed(found.fetchall(), theirs)
    assert rows[0] == rows[1] and rows[0]
