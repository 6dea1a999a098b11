import glob
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import daily_average
from tessera.plans import load_op as j2
from tessera.sinks import write_csv
from tessera.sources import read_csv
from tessera.streaming import consume_once, daily_average_stream, run_available_now

DATA = "/root/testdata/sf0.001"


def test_daily_average_stream_emits_closed_windows(spark, tmp_dir):
    ev = spark.read.parquet(f"{DATA}/events.parquet")
    src = os.path.join(tmp_dir, "src")
    ev.write.parquet(src)
    stream = spark.readStream.schema(ev.schema).parquet(src)
    out, ckpt = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ckpt")
    q = run_available_now(daily_average_stream(stream, "user_id", "event_type", "ts", "value", late="1 day"), out, ckpt,
                          fmt="parquet")
    assert q.exception() is None
    got = spark.read.parquet(out)
    batch = daily_average(ev, "user_id", "event_type", "ts", "value")
    assert got.count() > 0
    # every emitted window is final and equals the batch result for that window
    joined = got.join(batch, ["user_id", "event_type", "window_start"])
    assert joined.count() == got.count()
    assert joined.filter(F.abs(got["average"] - batch["average"]) > 1e-9).count() == 0
    # windows still open at the end of the data (within the lateness) are not emitted
    newest = ev.agg(F.max("ts")).first()[0]
    assert got.filter(F.col("window_end") > F.lit(newest)).count() == 0


COLUMNS = ["a", "b"]


def landed(spark, rows, path, **options):
    j2.put_file(spark.createDataFrame(rows, "a string, b string"), path, **options)


def rows_of(spark, out):
    return sorted(tuple(r) for r in j2.read_output(spark, out).select("Op", "a", "b").collect())


def test_clean_up_removes_accepted_files_and_no_others(spark, tmp_dir):
    landing, out, checkpoint = (os.path.join(tmp_dir, n) for n in ("landing", "out", "ckpt"))
    landed(spark, [("1", "x")], f"{landing}/db/t/LOAD1.csv")
    landed(spark, [("2", "x")], f"{landing}/db/t/LOAD3_backup.csv")  # begins like a load file
    landed(spark, [("3", "x")], f"{landing}/db/t/changes.csv")
    write_csv(spark.createDataFrame([("4", "y")], "a string, b string"), f"{landing}/a/b/c/LOAD6.csv")  # a folder, deeper
    landed(spark, [("5", "z")], f"{landing}/x/LOAD7.csv.gz", compression="gzip")
    landed(spark, [], f"{landing}/db/t/LOAD8.csv")  # a header alone
    landed(spark, [("6", "q")], f"{landing}/db/t s/[1]/LOAD9.csv")  # characters of globs and URIs
    j2.add_load_op(spark, landing, out, COLUMNS, checkpoint, delete=True)
    assert rows_of(spark, out) == [("I", "1", "x"), ("I", "4", "y"), ("I", "5", "z"), ("I", "6", "q")]
    left = [os.path.relpath(p, landing) for p in glob.glob(f"{landing}/**/*.csv*", recursive=True) if os.path.isfile(p)]
    assert sorted(left) == ["db/t/LOAD3_backup.csv", "db/t/changes.csv"]
    # a second run finds nothing; a new file is read alone
    j2.add_load_op(spark, landing, out, COLUMNS, checkpoint, delete=True)
    landed(spark, [("7", None)], f"{landing}/db/t/LOAD2.csv")
    j2.add_load_op(spark, landing, out, COLUMNS, checkpoint, delete=True)
    assert rows_of(spark, out)[-1] == ("I", "7", None) and len(rows_of(spark, out)) == 5
    # the same output under another checkpoint: earlier batches stay
    landed(spark, [("8", "n")], f"{landing}/db/t/LOAD3.csv")
    j2.add_load_op(spark, landing, out, COLUMNS, os.path.join(tmp_dir, "other"), delete=True)
    assert len(rows_of(spark, out)) == 6


def test_replaced_files_stay_and_a_dead_run_is_cleaned_up_after(spark, tmp_dir):
    landing, checkpoint = os.path.join(tmp_dir, "landing"), os.path.join(tmp_dir, "ckpt")
    for n in (1, 2, 3):
        landed(spark, [(str(n), "x")], f"{landing}/db/t/LOAD{n}.csv")
    calls = []

    def write_batch(paths, name):
        calls.append((sorted(os.path.basename(p) for p in paths), name))
        if len(calls) == 1:
            raise RuntimeError("lost")
        # one file is replaced while its batch is written
        time.sleep(0.05)
        with open(f"{landing}/db/t/LOAD2.csv", "w") as f:
            f.write("a,b\n9,new\n")

    with pytest.raises(Exception, match="lost"):
        consume_once(spark, landing, j2.LOAD_FILE_PATTERN, checkpoint, write_batch, delete=True)
    assert len(os.listdir(f"{landing}/db/t")) >= 3  # nothing is removed before its batch is committed
    consume_once(spark, landing, j2.LOAD_FILE_PATTERN, checkpoint, write_batch, delete=True)
    assert calls[0] == calls[1]  # the batch is repeated under its name
    assert [f for f in os.listdir(f"{landing}/db/t") if f.endswith(".csv")] == ["LOAD2.csv"]
    # a note that a dead run left behind
    landed(spark, [("4", "x")], f"{landing}/db/t/LOAD4.csv")
    status = os.stat(f"{landing}/db/t/LOAD4.csv")
    consume_once(spark, landing, j2.LOAD_FILE_PATTERN, checkpoint, lambda *a: None)
    notes = glob.glob(f"{checkpoint}-accepted/*.json")
    assert [x["path"].endswith("LOAD4.csv") and x["size"] == status.st_size for n in notes for x in json.load(open(n))] == [True]
    consume_once(spark, landing, j2.LOAD_FILE_PATTERN, checkpoint, lambda *a: None, archive_dir=os.path.join(tmp_dir, "archive"))
    assert os.path.exists(os.path.join(tmp_dir, "archive", "db", "t", "LOAD4.csv"))
    assert not os.path.exists(f"{landing}/db/t/LOAD4.csv")


def test_in_place_output_is_one_write_for_any_number_of_files(spark, tmp_dir, monkeypatch):
    counts = []
    for n in (2, 9):
        landing = os.path.join(tmp_dir, f"landing{n}")
        for i in range(n):
            landed(spark, [(str(i), "x"), (str(i), "y")], f"{landing}/db/t{i}/LOAD{i}.csv")
        writes = []
        monkeypatch.setattr(j2, "write_csv", lambda *a, **k: (writes.append(a[1]), write_csv(*a, **k)))
        j2.add_load_op_in_place(spark, landing, COLUMNS, os.path.join(tmp_dir, f"ckpt{n}"), single_file=True)
        monkeypatch.setattr(j2, "write_csv", write_csv)
        counts.append(len(writes))
        for i in range(n):
            got = read_csv(spark, f"{landing}/db/t{i}/op-LOAD{i}.csv")
            assert sorted(tuple(r) for r in got.collect()) == [("I", str(i), "x"), ("I", str(i), "y")]
    assert counts == [1, 1]
