"""Every query against its SQL twin on the smallest tables."""

import datetime
import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from confab.registry import ORACLES, QUERIES
from confab.sources.tables import TABLES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, (float, np.floating)) and v != v):
        return "NULL"
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, (float, np.floating)):
        return f"{v:.6g}"
    if isinstance(v, (pd.Timestamp, datetime.datetime)):
        return v.isoformat()[:19]
    return str(v)


def rows(df):
    return sorted("|".join(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    found = QUERIES[name](spark, sf).toPandas()
    if name not in ORACLES:
        assert len(found)
        return
    want = duck.sql(ORACLES[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    assert rows(found) == rows(want)


def test_nothing_imports_the_corpus_operators():
    for path in glob.glob("confab/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert "confab.llm" not in open(path).read(), path
