"""Every registered query against its SQL twin on the small driver tables."""

import math

import duckdb
import pytest

from lorekeep import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return x


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    key = lambda r: tuple((v is None, str(v)) for v in r)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=key)


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    r = duck.execute(ORACLES[name])
    cols = [c[0] for c in r.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == rows_of(cols, r.fetchall())
    assert got, "an empty answer proves nothing"
