"""Every registered query beside its check SQL, on the smallest tables."""

import os

import pytest

from tests.conftest import FOLDER
from tools.check_queries import rows_of
from voxmill.catalog import CHECKS, QUERIES, runner
from voxmill.derived import BASE

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for b in BASE:
        c.execute(f"CREATE VIEW {b} AS SELECT * FROM '{FOLDER}/{b}.parquet'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = runner(name)(spark, FOLDER)
    cols, got = rows_of(df.columns, df.collect())
    if name not in CHECKS:
        assert cols
        return
    cur = con.execute(CHECKS[name])
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert cols == want_cols
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            # rounded values may differ in their last digit between engines
            assert x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-6 * max(1.0, abs(y))), (a, b)
