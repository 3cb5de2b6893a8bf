"""Every core query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import pytest

from sagebrook.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return round(float(v), 5) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return db


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    cursor = duck.execute(catalogue.ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert mine == sorted((tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in cursor.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, FOLDER).count() > 0
