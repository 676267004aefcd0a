"""Every registered query of the reference's operators against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from paperlake import plans

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


def norm(v):
    return round(v, 6) if isinstance(v, float) and math.isfinite(v) else v


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, sql, name):
    df = plans.queries()[name](spark, DIR)
    rows = df.collect()
    if name not in plans.oracle_sql():
        assert df.columns
        return
    r = sql.execute(plans.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(df.columns)
    got = sorted((tuple(norm(x[c]) for c in order) for x in rows), key=repr)
    want = sorted((tuple(norm(x[names.index(c)]) for c in order) for x in r.fetchall()), key=repr)
    assert got == want
