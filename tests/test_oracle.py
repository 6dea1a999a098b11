"""Every registered query against its SQL twin (DuckDB) on the smallest test tables."""

import inspect
import sys
import threading

import duckdb
import pytest

import __spark_entry__ as se
from tessera import operators, registry, sinks, sources, streaming
from tools.check_oracle import TABLES, digest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_a_twin():
    assert set(registry.QUERIES) == set(registry.ORACLE)


def test_entry_runs(spark):
    df = se.entry(spark)
    assert df.count() > 0
    assert df.columns == ["col0", "col1", "col2", "col3", "col4", "col5"]


CALLED = set()


def called(frame, event, _):
    if event == "call" and "/tessera/" in frame.f_code.co_filename:
        CALLED.add(frame.f_code.co_qualname)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, con, name):
    sys.setprofile(called)
    threading.setprofile(called)  # streaming batches call back from other threads
    try:
        df = registry.QUERIES[name](spark, SF)
    finally:
        sys.setprofile(None)
        threading.setprofile(None)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("PythonUDF", "EvalPython", "InArrow", "InPandas", "CartesianProduct"))
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(registry.ORACLE[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]


#: used where no given table can stand for their input (schemas, streams with a watermark, buckets), or by unit tests as the
#: column forms of what ``edges_at`` does
ELSEWHERE = {"ids_of", "nested_ids", "catalog_document", "columns_of", "columns_of_catalog", "columns_of_frames", "tables_of", "daily_average_stream", "ingest_new_files",
             "run_available_now", "write_bucketed"}


def test_every_operator_is_called_by_a_query():
    if len(CALLED) < 50:
        pytest.skip("needs the queries of this module to have run")
    public = {f.__name__ for m in (operators, sources, sinks, streaming) for f in vars(m).values() if inspect.isfunction(f)}
    assert sorted(public - CALLED - ELSEWHERE) == []
