"""Every query with SQL gives the SQL's rows on the smallest tables."""

import os

import pandas as pd
import pytest

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

from dossierlake import catalog  # noqa: E402
from dossierlake.plans.base import TABLES  # noqa: E402

SLOW = {"f5_lcs_ratio"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def normal(frame):
    frame = frame[sorted(frame.columns)]
    # whole numbers alike, whether a null beside them made the column one of floats or not
    cell = lambda x: None if x is None or x is pd.NA or x is pd.NaT or x != x else str(x) if not isinstance(x, float) else str(int(x)) if x.is_integer() else round(x, 5)
    return sorted(([cell(x) for x in row] for row in frame.astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(set(catalog.oracle_sql()) - SLOW))
def test_same_rows(spark, db, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), db.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = normal(got), normal(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert [str(v) for v in x] == [str(v) for v in y] or all(p == q or (isinstance(p, float) or isinstance(q, float)) and abs(float(p) - float(q)) < 1e-4 for p, q in zip(x, y))
