"""Queries of this subpackage against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from sessionloom.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = c.execute(registry.ORACLE_SQL[name])
    found = [x[0] for x in cursor.description]
    assert sorted(found) == columns
    assert sorted(tuple(r[x] for x in columns) for r in df.collect()) == sorted(tuple(r[found.index(x)] for x in columns) for r in cursor.fetchall())
