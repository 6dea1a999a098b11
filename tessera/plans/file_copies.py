"""Copies of file sets (B7 published names, A6 + C11 download layout): a plan as a DataFrame, one row for each
file, and the copying itself by Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.paths import dirname, relative_to, rewrite_key, target_path
from tessera.plans.bulk_load import list_files
from tessera.session import scratch_path
from tessera.sources.files import select_files

# Marker objects some stores create for folders.
FOLDER_MARKER = ".*_\\$folder\\$$"


def publish_plan(spark: SparkSession, result_root: str, database: str, target_root: str,
                 kind: str = "csv") -> DataFrame:
    """``(source, target)`` for every result file under ``{db}_{kind}/``: the key prefix
    ``{db}_{kind}`` becomes ``{db}`` (every occurrence, as a text replace does), CSV keys get a
    ``.csv`` suffix, folder markers are skipped."""
    files = list_files(spark, result_root).withColumn("key", relative_to(F.col("file"), result_root))
    chosen = select_files(files, "key", prefix=f"{database}_{kind}/", exclude_regex=FOLDER_MARKER)
    suffix = ".csv" if kind == "csv" else ""
    new_key = rewrite_key("key", f"{database}_{kind}", database, suffix)
    return chosen.select(F.col("file").alias("source"), target_path(new_key, target_root).alias("target"))


PIECE = 8 << 20


def _copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each file piece by piece, under another name until it is whole."""
    def place(path: str) -> tuple[pafs.FileSystem, str]:
        return (pafs.LocalFileSystem(), path.removeprefix("file://").removeprefix("file:")) if path.startswith(("/", "file:")) else pafs.FileSystem.from_uri(path)

    for batch in batches:
        sizes = []
        for source, target in zip(batch.column("source").to_pylist(), batch.column("target").to_pylist(), strict=True):
            (own, src), (there, dst) = place(source), place(target)
            folder, _, name = dst.rpartition("/")
            there.create_dir(folder, recursive=True)
            part, n = f"{folder}/.{name}.part", 0
            with own.open_input_stream(src) as read, there.open_output_stream(part) as write:
                while piece := read.read(PIECE):
                    write.write(piece)
                    n += len(piece)
            there.move(part, dst)
            sizes.append(n)
        yield pa.record_batch([batch.column("source"), batch.column("target"), pa.array(sizes, pa.int64())], names=["source", "target", "bytes"])


def copy_files(plan: DataFrame, tasks: int | None = None) -> DataFrame:
    """Copy every (source, target) of a plan byte for byte; (source, target, bytes) as done.

    The files are dealt to tasks (by default as many as the session's shuffle partitions); a task holds one piece of
    ``PIECE`` bytes at a time. A repeated task writes the same copies again, and a copy has its name only when it is whole. Runs when
    an action asks for the result. Stores are reached by their URI (local folders, HDFS, S3, GCS, Azure).
    """
    tasks = tasks or int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return plan.select("source", "target").repartition(tasks, "source").mapInArrow(_copied, "source string, target string, bytes long")


def publish(spark: SparkSession, result_root: str, database: str, target_root: str, kind: str = "csv") -> DataFrame:
    """Copy the result files of ``{result_root}/{db}_{kind}/`` to their published names below ``target_root``; what was copied."""
    path = scratch_path(spark, "published")
    copy_files(publish_plan(spark, result_root, database, target_root, kind)).write.parquet(path)
    return spark.read.parquet(path)


def download_plan(spark: SparkSession, root: str, prefix: str, target_dir: str) -> DataFrame:
    """A6 + C11: for every file whose key starts with ``prefix``: its key, the local folder to
    create (``target_dir/<key without its last part>``) and the output file ``target_dir/<key>``."""
    files = list_files(spark, root).withColumn("key", relative_to(F.col("file"), root))
    chosen = select_files(files, "key", prefix=prefix)
    return chosen.select("key", target_path(dirname("key"), target_dir).alias("out_dir"),
                         target_path(F.col("key"), target_dir).alias("output_file"), "bytes")
