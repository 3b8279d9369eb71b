"""Every registered query of the library with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from sonagrid.plans.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
TABLES = "customer supplier part orders events documents embeddings labels".split()
pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="no tables")


def plain(v):
    v = v.item() if hasattr(v, "item") else v
    return (None if math.isnan(v) else round(v, 6) + 0.0) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    expected = duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    assert got == sorted(repr([plain(r[expected.columns.index(c)]) for c in columns]) for r in expected.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[0] == "file"
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
