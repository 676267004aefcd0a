"""The registered queries of the operators against their SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from paperlake.llm import queries as Q

DIR = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


def norm(v):
    return round(v, 6) if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = Q.queries()[name](spark, DIR)
    r = con.execute(Q.oracle_sql()[name])
    names = [x[0] for x in r.description]
    order = sorted(names)
    assert order == sorted(df.columns)
    got = sorted((tuple(norm(x[c]) for c in order) for x in df.collect()), key=repr)
    assert got == sorted((tuple(norm(x[names.index(c)]) for c in order) for x in r.fetchall()), key=repr)
