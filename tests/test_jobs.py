import os

from pyspark.sql import functions as F

from tessera.plans import row_report as j10
from tessera.plans import scrub as j1
from tessera.plans import usage as j5
from tessera.sinks import read_report, write_report
from tessera.sources import read_csv

DATA = "/root/testdata/sf0.001"


def test_scrub_job_writes_both_layouts_and_publishes(spark, tmp_dir):
    rows = [("n1", 1, "a@b.com", "x\ny", 5), ("n2", 2, "not mail", None, None)]
    df = spark.createDataFrame(rows, "col1 string, col2 long, col3 string, col4 string, col5 long")
    df.createOrReplaceTempView("scrub_job_input")
    target = os.path.join(tmp_dir, "target")
    out, csv_back = j1.run(spark, None, "scrub_job_input", tmp_dir, "db1", publish_root=target)
    assert out.columns == ["col0", "col1", "col2", "col3", "col4", "col5"]
    assert out.count() == 2
    got = {r.col1: r for r in csv_back.collect()}
    assert got["n1"].col4 == "x y" and got["n1"].col3 != "a@b.com" and got["n2"].col3 == "not mail"
    # published names: the key without its layout, a suffix on CSV files
    published = os.listdir(os.path.join(target, "db1", "scrub_job_input"))
    assert any(f.endswith(".csv.csv") for f in published) and any(f.endswith(".parquet") for f in published)
    assert not any(f.endswith(".part") for f in published)
    assert read_csv(spark, os.path.join(target, "db1", "scrub_job_input"), glob="*.csv").count() == 2
    for f in published:
        if f.endswith(".csv.csv"):
            with open(os.path.join(target, "db1", "scrub_job_input", f), "rb") as a, open(os.path.join(tmp_dir, "db1_csv", "scrub_job_input", f[:-4]), "rb") as b:
                assert a.read() == b.read()


def test_scrub_keeps_row_count(spark):
    c = spark.read.parquet(f"{DATA}/customer.parquet")
    assert j1.scrub(j1.customer_input(c)).count() == c.count()


def test_usage_report_file(spark, tmp_dir):
    ev = spark.read.parquet(f"{DATA}/events.parquet")
    rep = j5.usage_report(j5.events_table(ev), "user_id")
    p = os.path.join(tmp_dir, "report")
    write_report(rep, p)
    back = read_csv(spark, p)
    assert back.columns == j5.REPORT_COLUMNS
    rows = sorted(back.collect(), key=lambda r: int(r.Row))
    assert [int(r.Row) for r in rows] == list(range(1, len(rows) + 1))
    several = os.path.join(tmp_dir, "several")
    write_report(rep, several, files=5)
    assert len([f for f in os.listdir(several) if f.endswith(".csv")]) > 1
    assert all(int(r.Row) == r.line for r in read_report(spark, several).collect())
    one = os.path.join(tmp_dir, "one")
    write_report(rep, one, files=1)
    assert len([f for f in os.listdir(one) if f.endswith(".csv")]) == 1


def test_usage_entities_without_data_are_zero(spark):
    m = spark.createDataFrame([("b1", "StandardStorage", "2024-01-02 05:00:00", 1500),
                               ("b1", "StandardIAStorage", "2024-01-02 06:00:00", 999),
                               ("b1", "StandardStorage", "2024-01-01 05:00:00", 10 ** 9)],
                              "bucket string, storage_type string, ts string, value long") \
        .withColumn("ts", F.to_timestamp("ts"))
    buckets = spark.createDataFrame([("b1",), ("b2",)], "bucket string")
    sizes = j5.daily_sizes(m, "bucket", "storage_type", "ts", "value", "2024-01-03")
    rep = {r.Bucket: r for r in j5.usage_report(j5.usage_table(sizes, buckets, "bucket"), "bucket").collect()}
    assert (rep["b1"].Row, rep["b1"].StandardSize, rep["b1"].IASize, rep["b1"].Total) == (1, "1.5KB", "999B", "2.5KB")
    assert (rep["b2"].Row, rep["b2"].Total) == (2, "0B")


def test_row_report_header_and_recipient():
    text, html = j10.header_lines(["a", "b<c"])
    assert text == "a,b<c" and html == "<tr><th>a</th><th>b&lt;c</th></tr>"
    assert j10.valid_recipient("x.y+z@mail.example.com")
    assert not j10.valid_recipient("x@y")


def test_row_report_from_csv(spark, tmp_dir):
    from tessera.sinks import write_csv

    p = os.path.join(tmp_dir, "in")
    write_csv(spark.createDataFrame([("a&b", "1"), (None, "2")], "name string, n string").coalesce(1), p)
    (text, html), lines = j10.report_from_csv(spark, p)
    assert text == "name,n" and html == "<tr><th>name</th><th>n</th></tr>"
    got = sorted(tuple(r) for r in lines.collect())
    assert got == [(",2", "<tr><td></td><td>2</td></tr>"), ("a&b,1", "<tr><td>a&amp;b</td><td>1</td></tr>")]
