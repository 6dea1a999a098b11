"""The queries that SQL can express against DuckDB."""

import duckdb
import pytest

from tessera.llm.queries import ORACLE, QUERIES
from tools.check_oracle import digest

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(ORACLE[name])
    names = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(names)
    assert digest(df.columns, rows)[0] == digest(names, res.fetchall())[0]
