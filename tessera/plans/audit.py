"""J4 audit_files: rows, rows with a null key and valid rows per CSV file of a folder, one scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.aggregates import audit_files
from tessera.operators.filters import null_key_rows
from tessera.sources.files import read_csv, with_file_path


def read_folder(spark: SparkSession, path: str, suffix: str = ".csv", multi_line: bool = True,
                recursive: bool = False) -> DataFrame:
    """A2 + A6: every ``*suffix`` file of the folder, quoted newlines allowed, with its file path."""
    df = read_csv(spark, path, multi_line=multi_line, glob=f"*{suffix}", recursive=recursive)
    return with_file_path(df, "file")


def audit(spark: SparkSession, path: str, key: str = "id", by: str = "file", **read_args) -> DataFrame:
    """F2 per file (or per folder with ``by='folder'``) plus a total row marked ``is_total``."""
    df = read_folder(spark, path, **read_args)
    if by == "folder":
        df = df.withColumn("folder", F.regexp_extract("file", "^(.*)/[^/]*$", 1))
    return audit_files(df, key, file_col=by)


def null_rows(spark: SparkSession, path: str, key: str = "id", **read_args) -> DataFrame:
    """the rows whose key is null, with their file (a DataFrame, not a printout)."""
    return null_key_rows(read_folder(spark, path, **read_args), key)


def events_folder(events: DataFrame, path: str) -> None:
    """Test-data shape: events as a CSV folder per event type; ``id`` is missing where value < 1."""
    from tessera.sinks.files import write_csv

    out = events.select(F.when(F.col("value") >= 1, F.col("event_id")).alias("id"), "ts", "user_id",
                        "value", "props", "event_type")
    write_csv(out, path, partition_by="event_type", timestamp_format="yyyy-MM-dd HH:mm:ss.SSSSSS")
