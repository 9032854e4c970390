"""Every registered study query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from quadrat.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return (0, 0.0, "")
    if isinstance(x, bool):
        return (1, float(x), "")
    if isinstance(x, (int, float)):
        return (1, round(float(x), 5) + 0.0, "")
    return (2, 0.0, str(x).split("+")[0] if str(x).endswith("+00:00") else str(x))


def close(a, b):
    return len(a) == len(b) and all(x[0] == y[0] and x[2] == y[2] and abs(x[1] - y[1]) <= 2e-5 * max(1, abs(x[1])) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, con):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(value(r[c]) for c in columns) for r in df.collect())
    if name not in catalog.SQL:
        assert got
        return
    found = con.execute(catalog.SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(value(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert close(got, want), [(g, w) for g, w in zip(got, want, strict=False) if g != w][:2]


def test_entry_has_rows_and_every_sql_a_query(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
