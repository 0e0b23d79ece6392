"""Every query of the catalog against its SQL, over the smallest tables."""

import math
import os

import duckdb
import pytest

from curalake import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    rows = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    at = [want.columns.index(c) for c in sorted(want.columns)]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert not any(isinstance(v, float) and math.isnan(v) for r in df.head(100) for v in r)
