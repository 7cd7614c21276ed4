"""Every registered query equals its SQL on DuckDB."""

import math

import duckdb
import pytest

from strata.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if x is None or isinstance(x, str):
        return x
    if isinstance(x, bool):
        return x
    x = float(x) if not isinstance(x, int) else x
    return None if isinstance(x, float) and math.isnan(x) else round(float(x), 9)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.execute(catalogue.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in columns]
    a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    b = sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)
    assert a == b


def test_all_have_sql():
    assert set(catalogue.SQL) == set(catalogue.QUERIES)
