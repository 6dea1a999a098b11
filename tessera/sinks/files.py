"""Sinks (B1-B6, B8, B10): CSV and Parquet writers, dual write, JSON documents, ranked reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.projection import drop_null_fields
from tessera.sources.files import CSV_OPTIONS


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", header: bool = True,
              null_marker: str | None = None, single_file: bool = False, quote_all: bool = False,
              timestamp_format: str = "yyyy-MM-dd HH:mm:ss", partition_by=None, **options) -> None:
    """CSV with the readers' dialect (``escape='"'`` on both sides).

    ``null_marker`` writes null as that text (the reader must be given the same marker).
    ``single_file`` coalesces to one task (no shuffle; opt in only for small outputs).
    ``mode='append'`` into a source's own folder is B6.
    """
    out = drop_null_fields(df)  # the CSV writer rejects void columns
    if single_file:
        out = out.coalesce(1)
    # the writer trims surrounding blanks unless told not to: keep values exactly
    w = out.write.mode(mode).options(**CSV_OPTIONS).option("header", str(header).lower()) \
        .option("quoteAll", str(quote_all).lower()) \
        .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false") \
        .option("timestampFormat", timestamp_format).option("timestampNTZFormat", timestamp_format)
    if null_marker is not None:
        w = w.option("nullValue", null_marker)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.options(**{k: str(v) for k, v in options.items()}).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None) -> None:
    """B2."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.parquet(path)


def write_bucketed(df: DataFrame, table: str, keys, buckets: int, mode: str = "overwrite") -> None:
    """A table stored bucketed (and sorted) by its key: later joins on the key against it
    (e.g. the upsert's anti-join) shuffle only the other side."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    df.write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(table)


def dual_paths(base: str, database: str, table: str) -> tuple[str, str]:
    """``{base}/{db}_csv/{table}`` and ``{base}/{db}_parquet/{table}``."""
    base = base.rstrip("/")
    return f"{base}/{database}_csv/{table}", f"{base}/{database}_parquet/{table}"


def write_dual(df: DataFrame, base: str, database: str, table: str, mode: str = "overwrite") -> tuple[str, str]:
    """The same rows as Parquet and as header CSV.

    The expensive plan (scan + hashing) runs once: Parquet is written first (after C9) and the
    CSV copy is produced from those written files, which also survives executor loss, unlike a
    cached copy.
    """
    csv_path, parquet_path = dual_paths(base, database, table)
    write_parquet(drop_null_fields(df), parquet_path, mode)
    written = df.sparkSession.read.parquet(parquet_path)
    # a CSV field holds text: nested columns go there as JSON
    flat = [F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(f"`{f.name}`")
            for f in written.schema.fields]
    write_csv(written.select(*flat), csv_path, mode)
    return csv_path, parquet_path


def write_json_lines(df: DataFrame, column: str, path: str, mode: str = "overwrite") -> None:
    """One JSON document a line; it never has to pass through the driver whole."""
    df.select(column).write.mode(mode).text(path)


def write_report(report: DataFrame, path: str, order_col: str = "Row", files: int | None = None) -> None:
    """A ranked report as header CSV, in rank order.

    Rows are dealt by range of rank: each file is written by one task, sorted, and files in the order of their names
    (part numbers) follow each other in rank; :func:`read_report` reads them so. ``files=1`` asks for a single file (B5);
    left out, their number follows the rows (small neighbours are put together at run time).
    """
    dealt = report.repartitionByRange(*([files] if files else []), order_col)
    write_csv(dealt.sortWithinPartitions(order_col), path)


def read_report(spark: SparkSession, path: str, name: str = "line") -> DataFrame:
    """A written report with the place of each row in it (from 1): files by name, rows as they stand in the file.

    Only the number of rows of each file is brought together to number them.
    """
    rows = spark.read.options(**CSV_OPTIONS).csv(path).select("*", F.col("_metadata.file_name").alias("__name"), F.col("_metadata.file_block_start").alias("__block"),
                                                              F.monotonically_increasing_id().alias("__at"))
    # one row for each file, or split of a large one
    sizes = rows.groupBy("__name", "__block").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    earlier = Window.orderBy("__name", "__block").rowsBetween(Window.unboundedPreceding, -1)
    begin = sizes.select("__name", "__block", "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__begin"))
    out = rows.join(F.broadcast(begin), ["__name", "__block"])
    return out.withColumn(name, F.col("__begin") + F.col("__at") - F.col("__first") + 1).drop("__name", "__block", "__at", "__first", "__begin")
