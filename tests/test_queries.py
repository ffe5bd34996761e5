"""Every query with SQL against DuckDB on the smallest tables; the others for rows and columns."""

import glob
import os

import duckdb
import pytest

from tidegrid.plans import catalog


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(None if x != x or x is None else round(x, 6) if isinstance(x, float) else str(x) for x in r) for r in df.astype(object).itertuples(index=False, name=None))


def plain(df):
    return [[None if v is None or v != v else round(float(v), 5) if isinstance(v, float) else v for v in r] for r in rows(df)]


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, duck, sf, name):
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    keys = [c for c in sorted(got.columns) if got[c].dtype.kind not in "f"] + [c for c in sorted(got.columns) if got[c].dtype.kind == "f"]
    a, b = (d.sort_values(keys).reset_index(drop=True) for d in (got, want))
    for c in got.columns:
        if a[c].dtype.kind == "f" or b[c].dtype.kind == "f":
            x, y = a[c].astype(float), b[c].astype(float)
            assert ((x.isna() & y.isna()) | ((x - y).abs() <= 1e-6 * (1 + y.abs()))).all(), c
        else:
            assert a[c].astype(str).tolist() == b[c].astype(str).tolist(), c


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_without_sql(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
