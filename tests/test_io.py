import collections
import os

import pytest
from pyspark.sql import functions as F

from tessera.plans import bulk_load as j9
from tessera.plans import load_op as j2
from tessera.plans.positional import csv_round_trip
from tessera.sinks import write_csv, write_dual
from tessera.sources import path_columns, read_csv, select_files, with_file_path


def test_csv_round_trip_quotes_newlines_null_marker(spark, tmp_dir):
    rows = [(1, 'q"x,', "line1\nline2", None), (2, "  padded  ", "", "NA-ish"), (3, None, "a,b", "x")]
    df = spark.createDataFrame(rows, "id int, a string, b string, c string")
    back = csv_round_trip(df, os.path.join(tmp_dir, "rt"), null_marker="NA")
    got = sorted(tuple(r) for r in back.collect())
    assert got == [("1", 'q"x,', "line1\nline2", None), ("2", "  padded  ", "", "NA-ish"), ("3", None, "a,b", "x")]


def test_na_marker_is_ambiguous_without_reader_marker(spark, tmp_dir):
    df = spark.createDataFrame([(None,), ("NA",)], "v string")
    p = os.path.join(tmp_dir, "na")
    write_csv(df, p, null_marker="NA")
    plain = read_csv(spark, p, multi_line=True)
    assert sorted(r[0] for r in plain.collect()) == ["NA", "NA"]


def test_select_files_rule(spark):
    paths = ["s3/db/t/LOAD00000001.csv", "s3/db/t/LOAD1.csv.gz", "LOAD1.csv", "s3/db/t/x.csv",
             "s3/db/t/LOADX.csv", "s3/db_csv/t/_$folder$"]
    df = spark.createDataFrame([(p,) for p in paths], "file string")
    got = [r[0] for r in select_files(df, name_regex=j2.LOAD_FILE_PATTERN).collect()]
    assert got == ["s3/db/t/LOAD00000001.csv", "s3/db/t/LOAD1.csv.gz"]
    got = [r[0] for r in select_files(df, prefix="s3/db_csv/", exclude_regex=".*_\\$folder\\$$").collect()]
    assert got == []


def test_path_columns_depth(spark):
    df = spark.createDataFrame([("/r/db/t/f.csv",), ("/r/db/f.csv",), ("/r/a/b/c/d.csv",)], "file string")
    got = [tuple(r) for r in path_columns(df, "/r").select("bad_path", "database", "table", "file_name").collect()]
    assert got == [(False, "db", "t", "f.csv"), (True, None, None, None), (True, None, None, None)]


def test_write_dual_layout(spark, tmp_dir):
    df = spark.createDataFrame([(1, "a\nb")], "x int, y string")
    csv_path, pq_path = write_dual(df, tmp_dir, "db1", "table1")
    assert csv_path.endswith("db1_csv/table1") and pq_path.endswith("db1_parquet/table1")
    assert spark.read.parquet(pq_path).count() == 1
    assert read_csv(spark, csv_path, multi_line=True).first()["y"] == "a\nb"


def test_bulk_load_status(spark, tmp_dir):
    root = os.path.join(tmp_dir, "landing")
    base = spark.createDataFrame([(1, "a", 1.5), (2, "b", 2.5)], "k long, v string, x double")
    inc = spark.createDataFrame([(2, "b1", 0.5), (2, "b2", 9.0), (3, "c", 3.0)], "k long, v string, x double")
    write_csv(inc.coalesce(1), f"{root}/db/t")
    write_csv(inc.coalesce(1), f"{root}/db/other")
    write_csv(inc.coalesce(1), f"{root}/stray")
    results, status = j9.bulk_load(spark, root, {("db", "t"): (base, ["k"])})
    assert sorted(tuple(r) for r in results[("db", "t")].collect()) == [(1, "a", 1.5), (2, "b2", 9.0), (3, "c", 3.0)]
    st = {(r.database, r.table, r.status, r.reason, r.n_rows) for r in status.filter(F.col("file").endswith(".csv")).collect()}
    assert ("db", "t", "Success", None, 3) in st
    assert ("db", "other", "Failed", "unknown table", None) in st
    assert (None, None, "Failed", "bad path", None) in st


def test_file_stream_consumes_each_file_once(spark, tmp_dir):
    landing, out = os.path.join(tmp_dir, "landing"), os.path.join(tmp_dir, "out")
    ckpt, archive = os.path.join(tmp_dir, "ckpt"), os.path.join(tmp_dir, "archive")
    cols = ["a", "b"]
    write_csv(spark.createDataFrame([("1", "x")], "a string, b string"), f"{landing}/db/t/LOAD00000001.csv")
    write_csv(spark.createDataFrame([("U", "9", "z")], "Op string, a string, b string"), f"{landing}/db/t/cdc.csv")
    j2.add_load_op(spark, landing, out, cols, ckpt, archive)
    first = j2.read_output(spark, out)
    assert first.columns[0] == "Op"
    assert [tuple(r) for r in first.select("Op", "a", "b", "database", "table").collect()] == [("I", "1", "x", "db", "t")]
    write_csv(spark.createDataFrame([("2", "y")], "a string, b string"), f"{landing}/db/t/LOAD00000002.csv")
    j2.add_load_op(spark, landing, out, cols, ckpt, archive)
    got = sorted(tuple(r) for r in j2.read_output(spark, out).select("Op", "a", "b").collect())
    assert got == [("I", "1", "x"), ("I", "2", "y")]
    # consumed files are moved out of the landing folder, one run later and in the background
    import time

    def archived():
        return [f for d, _, fs in os.walk(archive) for f in fs if "LOAD00000001" in d and f.endswith(".csv")]
    deadline = time.time() + 30
    while not archived() and time.time() < deadline:
        time.sleep(0.5)
    assert archived()
    assert not [f for d, _, fs in os.walk(landing) for f in fs if "LOAD00000001" in d and f.endswith(".csv")]
    # the change file was never consumed
    assert [f for d, _, fs in os.walk(landing) for f in fs if "cdc.csv" in d and f.endswith(".csv")]


def test_with_file_path(spark, tmp_dir):
    p = os.path.join(tmp_dir, "f")
    write_csv(spark.createDataFrame([("1",)], "id string"), p)
    df = with_file_path(read_csv(spark, p), "file")
    assert df.first()["file"].endswith(".csv")


def test_load_op_in_place(spark, tmp_dir):
    landing = os.path.join(tmp_dir, "landing")
    write_csv(spark.createDataFrame([("1", "x"), ("2", None)], "a string, b string"), f"{landing}/db/t/LOAD00000001.csv")
    write_csv(spark.createDataFrame([("3", "y")], "a string, b string"), f"{landing}/db/u/LOAD00000001.csv")
    j2.add_load_op_in_place(spark, landing, ["a", "b"], os.path.join(tmp_dir, "ckpt"), single_file=True)
    # the output sits in each load file's folder, under a name the load rule does not take
    out = read_csv(spark, f"{landing}/db/t/op-*")
    assert out.columns == ["Op", "a", "b"]
    assert sorted(tuple(r) for r in out.collect()) == [("I", "1", "x"), ("I", "2", None)]
    folders = [f for f in os.listdir(f"{landing}/db/t") if f.startswith("op-")]
    assert folders
    assert all(len([f for f in os.listdir(f"{landing}/db/t/{x}") if f.endswith(".csv")]) == 1 for x in folders)
    # a run with a new checkpoint rewrites the same files
    j2.add_load_op_in_place(spark, landing, ["a", "b"], os.path.join(tmp_dir, "ckpt2"), single_file=True)
    assert sorted(tuple(r) for r in read_csv(spark, f"{landing}/db/t/op-*").collect()) == [("I", "1", "x"), ("I", "2", None)]
    other = read_csv(spark, f"{landing}/db/u/op-*")
    assert [tuple(r) for r in other.collect()] == [("I", "3", "y")]


def test_catalog_table_and_columns(spark):
    from tessera.plans.catalog import schema_catalog, schema_document
    from tessera.sources import columns_of_catalog, read_table, tables_of

    spark.sql("CREATE DATABASE IF NOT EXISTS tdb")
    spark.createDataFrame([(1, "a", 2.5)], "id bigint, name string, amount double") \
        .write.mode("overwrite").saveAsTable("tdb.t1")
    assert read_table(spark, "tdb", "t1").count() == 1
    cols = columns_of_catalog(spark, "tdb")
    assert [r.table for r in tables_of(cols, "tdb").collect()] == ["t1"]
    got = [(r.position, r.column, r.mapped_type) for r in schema_catalog(cols, "tdb").orderBy("position").collect()]
    assert got == [(1, "id", "long"), (2, "name", "string"), (3, "amount", "float")]
    doc = schema_document(schema_catalog(cols, "tdb")).first()
    assert doc.columns == "id,name,amount" and doc.schema == '{"id":"long","name":"string","amount":"float"}'


def test_publish_and_download_plans(spark, tmp_dir):
    from tessera.plans.file_copies import download_plan, publish_plan

    df = spark.createDataFrame([(1, "a")], "x int, y string")
    write_dual(df, tmp_dir, "db1", "table1")
    with open(os.path.join(tmp_dir, "db1_csv", "x_$folder$"), "w") as fh:
        fh.write("")
    plan = publish_plan(spark, tmp_dir, "db1", "s3://target").collect()
    assert plan and all("/db1_csv/table1/" in r.source for r in plan)
    assert all(r.target.startswith("s3://target/db1/table1/") and r.target.endswith(".csv") for r in plan)
    assert not any("$folder$" in r.source for r in plan)
    dl = download_plan(spark, tmp_dir, "db1_parquet/", "/data").collect()
    assert dl and all(r.out_dir == "/data/db1_parquet/table1" for r in dl)
    assert all(r.output_file == "/data/" + r.key for r in dl)


@pytest.mark.parametrize("most", [1, 64])
def test_load_op_in_place_sorts_no_rows(spark, tmp_dir, monkeypatch, most):
    """One task writes files whose splits reach it in turns, unsorted, and each to one file however many may be open."""
    landing, seen = os.path.join(tmp_dir, "landing"), []
    for n in range(4):
        j2.put_file(spark.range(n * 1000, n * 1000 + 300).selectExpr("cast(id as string) a"), f"{landing}/db/t/LOAD{n}.csv")

    def watched(df, path, **options):
        seen.append(df.sparkSession.conf.get("spark.sql.maxConcurrentOutputFileWriters"))
        write_csv(df, path, **options)

    monkeypatch.setattr(j2, "write_csv", watched)
    monkeypatch.setattr(j2, "OPEN_FILES", most)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes")}
    writers = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
        j2.add_load_op_in_place(spark, landing, ["a"], os.path.join(tmp_dir, "ckpt"), single_file=True)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert seen == [str(most)] and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == writers
    for n in range(4):
        folder = f"{landing}/db/t/op-LOAD{n}.csv"
        assert len([f for f in os.listdir(folder) if f.endswith(".csv")]) == 1
        assert sorted(int(r.a) for r in read_csv(spark, folder).collect()) == list(range(n * 1000, n * 1000 + 300))


def test_bulk_load_bad_values_fail_their_file_only(spark, tmp_dir):
    root = os.path.join(tmp_dir, "landing")
    base = spark.createDataFrame([(1, 1.5)], "k long, x double")
    write_csv(spark.createDataFrame([("2", "2.5")], "k string, x string").coalesce(1), f"{root}/db/t")
    write_csv(spark.createDataFrame([("3", "oops")], "k string, x string").coalesce(1), f"{root}/db/t", mode="append")
    results, status = j9.bulk_load(spark, root, {("db", "t"): (base, ["k"])})
    assert sorted(tuple(r) for r in results[("db", "t")].collect()) == [(1, 1.5), (2, 2.5)]
    st = sorted((r.status, r.reason, r.n_bad_values) for r in status.filter(F.col("file").endswith(".csv")).collect())
    assert st == [("Failed", "bad values", 1), ("Success", None, 0)]
    results, status = j9.bulk_load(spark, root, {("db", "t"): (base, ["k"])}, ignore_errors=["bad values"])
    assert sorted(tuple(r) for r in results[("db", "t")].collect()) == [(1, 1.5), (2, 2.5), (3, None)]
    assert {r.status for r in status.filter(F.col("file").endswith(".csv")).collect()} == {"Success"}


def test_load_files_at_every_depth_and_compressed(spark, tmp_dir):
    import gzip

    landing = os.path.join(tmp_dir, "landing")
    for folder in ("db", "db/t", "db/t/2024/01"):
        os.makedirs(f"{landing}/{folder}", exist_ok=True)
        with open(f"{landing}/{folder}/LOAD0000000{folder.count('/')}.csv", "w") as f:
            f.write(f"a,b\n{folder},1\n")
    with gzip.open(f"{landing}/db/t/LOAD00000009.csv.gz", "wt") as f:
        f.write("a,b\ngz,1\n")
    with open(f"{landing}/db/t/change.csv", "w") as f:
        f.write("a,b\nno,1\n")
    out = os.path.join(tmp_dir, "out")
    j2.add_load_op(spark, landing, out, ["a", "b"], os.path.join(tmp_dir, "ckpt"))
    assert sorted(r.a for r in j2.read_output(spark, out).collect()) == ["db", "db/t", "db/t/2024/01", "gz"]


def test_bulk_load_quoted_newlines_and_ragged_rows(spark, tmp_dir):
    root = os.path.join(tmp_dir, "root")
    os.makedirs(f"{root}/db/t")
    with open(f"{root}/db/t/good.csv", "w") as f:
        f.write('k,v\n1,"line1\nline2"\n2,x\n')
    with open(f"{root}/db/t/ragged.csv", "w") as f:
        f.write("k,v\n2,y,extra\n3\n")
    base = spark.createDataFrame([("1", "a"), ("3", "c")], "k string, v string")
    results, status = j9.bulk_load(spark, root, {("db", "t"): (base, ["k"])})
    assert sorted(tuple(r) for r in results[("db", "t")].collect()) == [("1", "line1\nline2"), ("2", "x"), ("3", "c")]
    st = {os.path.basename(r.file): (r.status, r.reason) for r in status.collect()}
    assert st == {"good.csv": ("Success", None), "ragged.csv": ("Failed", "bad values")}


def test_bulk_load_of_a_large_batch_sorts_no_rows(spark, tmp_dir, monkeypatch):
    """Narrow sides are hashed; the last row in file order wins, also for a hot key and for rows without a key."""
    monkeypatch.setattr(j9, "LARGE_BATCH", 0)
    root = os.path.join(tmp_dir, "in")
    for name, rows in (("b", [("1", "late"), (None, "none"), ("4", "new")]), ("a", [("1", "early")] * 40 + [("3", "a"), ("3", "z"), ("3", "b")])):
        j2.put_file(spark.createDataFrame(rows, "k string, v string"), f"{root}/db/t/{name}.csv")
    base = spark.createDataFrame([(1, "old"), (2, "kept"), (2, "kept"), (None, "kept")], "k int, v string")
    new = j9.load_table(spark, root, "db", "t", base, ["k"])[0]
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortAggregate" not in plan and "SortMergeJoin" not in plan
    rows = collections.Counter(tuple(r) for r in new.collect())
    assert rows == collections.Counter([(2, "kept"), (2, "kept"), (None, "kept"), (1, "late"), (None, "none"), (4, "new"), (3, "b")])


def test_bulk_load_scans_the_csv_once(spark, tmp_dir):
    root = os.path.join(tmp_dir, "landing")
    base = spark.createDataFrame([(1, 1.5)], "k long, x double")
    write_csv(spark.createDataFrame([("2", "2.5")], "k string, x string").coalesce(1), f"{root}/db/t")
    results, status = j9.bulk_load(spark, root, {("db", "t"): (base, ["k"])})
    for df in (results[("db", "t")], status):
        assert "Scan csv" not in df._jdf.queryExecution().executedPlan().toString().replace("FileScan csv", "Scan csv")
    # the landing files may go once the load has read them
    for f in os.listdir(f"{root}/db/t"):
        os.remove(f"{root}/db/t/{f}")
    assert sorted(tuple(r) for r in results[("db", "t")].collect()) == [(1, 1.5), (2, 2.5)]
