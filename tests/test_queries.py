import math
from pathlib import Path

import duckdb
import pytest

from trackloom.operators.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS FROM '{f}'")
    return con


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: round(float(v), 5) + 0.0 if isinstance(v, float) else int(v) if isinstance(v, int) and not isinstance(v, bool) else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    want = con.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    got, expected = normal(df.columns, map(tuple, df.collect())), normal(want.columns, want.fetchall())
    assert len(got) == len(expected) and got
    for a, b in zip(got, expected):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, abs_tol=2e-5) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
