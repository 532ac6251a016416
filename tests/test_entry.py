"""Every registered query runs at the smallest scale and agrees with its SQL twin."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from sessionloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v if v is None or isinstance(v, (int, bool, str)) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@needs_data
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    cursor = duck.execute(registry.ORACLE_SQL[name])
    found = [x[0] for x in cursor.description]
    assert sorted(found) == columns
    assert rows == sorted((tuple(plain(r[found.index(c)]) for c in columns) for r in cursor.fetchall()), key=str)


@needs_data
def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["offset", "seq", "type", "agent_id", "attempt", "payload", "elapsed_ms"]
    rows = out.collect()
    assert rows and [r.offset for r in rows] == sorted({r.offset for r in rows}) and rows[0].elapsed_ms == 0


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
