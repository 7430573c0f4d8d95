import math
import os

import duckdb
import pytest

from strataline import queries

SF = "/root/testdata/sf0.001"


def norm(x):
    if isinstance(x, float):
        return "null" if math.isnan(x) else round(x, 4) + 0.0
    return "null" if x is None else x


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    if name not in queries.ORACLES:
        assert got
        return
    rel = duck.sql(queries.ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-3 * max(1, abs(x))) for x, y in zip(a, b)), (a, b)
