"""Skew evidence from Spark's event log: a third of all rows on one key.

Runs the id-map (F8) and the last-row-per-key pick (B9) on `lineitem`-derived data where one
group / key holds every third row, then reads the event log (written to a scratch folder) and
prints, per stage, the task count and the largest and median shuffle bytes read by one task.

Usage: python tools/skew_check.py [sf_dir]
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from tessera.operators import group_ids, latest_per_key  # noqa: E402
from tessera.session import build_session  # noqa: E402


def stage_stats(log_dir: str) -> list[tuple[str, int, int, int, int]]:
    """(job description, stage, tasks, largest and median shuffle bytes read by one task)."""
    reads: dict[int, list[int]] = {}
    label_of: dict[int, str] = {}
    for path in sorted(glob.glob(os.path.join(log_dir, "**", "*"), recursive=True)):
        if os.path.isdir(path):
            continue
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                if ev.get("Event") == "SparkListenerJobStart":
                    desc = (ev.get("Properties") or {}).get("spark.job.description", "")
                    for sid in ev.get("Stage IDs", []):
                        label_of[sid] = desc
                if ev.get("Event") != "SparkListenerTaskEnd":
                    continue
                m = (ev.get("Task Metrics") or {}).get("Shuffle Read Metrics") or {}
                n = m.get("Local Bytes Read", 0) + m.get("Remote Bytes Read", 0)
                reads.setdefault(ev["Stage ID"], []).append(n)
    out = []
    for sid in sorted(reads):
        r = reads[sid]
        if max(r) == 0:
            continue
        out.append((label_of.get(sid, ""), sid, len(r), max(r), int(statistics.median(r))))
    return out


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="tessera-eventlog-")
    spark = build_session("local[8]", 32, extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                                                 "spark.eventLog.compress": "false",
                                                 "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    hot = (F.col("l_orderkey") % 3 == 0)
    edges = li.select(F.when(hot, F.lit("hot")).otherwise(F.col("l_suppkey").cast("string")).alias("g"),
                      F.lit("PART").alias("t"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("i"))
    n = li.count()
    chunk = max(1000, n // 60)

    labels = []

    def run(label, df):
        spark.sparkContext.setJobDescription(label)
        df.write.format("noop").mode("overwrite").save()
        labels.append(label)

    print(f"rows {n}, hot group/key rows ~{n // 3}, chunk_size {chunk}")
    run("group_ids, bounded parts", group_ids(edges, "g", "t", "i", chunk_size=chunk))
    run("group_ids, one row per group (chunk_size=None)", group_ids(edges, "g", "t", "i", chunk_size=None))
    batch = li.select(F.when(hot, F.lit(-1)).otherwise(F.col("l_orderkey")).alias("k"),
                      F.col("l_linenumber").alias("seq"), "l_partkey", "l_quantity")
    run("latest_per_key with a hot key", latest_per_key(batch, ["k"], ["seq"]))
    spark.stop()
    print(f"{'job':48s} stage tasks  max_bytes_one_task  median_bytes")
    for label, sid, tasks, mx, med in stage_stats(log_dir):
        print(f"{label[:48]:48s} {sid:5d} {tasks:5d}  {mx:18d}  {med:12d}")


if __name__ == "__main__":
    main()
