"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from '{path}'")
    return con


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    out = []
    for r in pdf.itertuples(index=False):
        out.append(
            tuple(
                None
                if pd.isna(v)
                else (float(v) if not isinstance(v, str) else v)
                for v in r
            )
        )
    return sorted(out, key=lambda r: [(v is None, str(type(v)), v) for v in r])


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, sf, name):
    got = entry.queries()[name](spark, sf).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for v, w in zip(x, y, strict=True):
            same = v == w or (
                isinstance(v, float) and isinstance(w, float) and math.isclose(v, w, rel_tol=1e-9, abs_tol=2e-6)
            )
            assert same, (x, y)
