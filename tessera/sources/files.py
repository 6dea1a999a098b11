"""File sources (A1, A2, A6, A7): header CSV folders, path selection and path-derived columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.paths import key_parts, relative_to

# The CSV dialect of the source jobs (header line, '"' quote, '"' doubles itself).
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"'}


def csv_reader(spark: SparkSession, schema: T.StructType | str | None = None, multi_line: bool = False,
               null_marker: str | None = None, **options):
    r = spark.read.options(**CSV_OPTIONS)
    if multi_line:
        r = r.option("multiLine", "true")
    if null_marker is not None:
        r = r.option("nullValue", null_marker)
    if schema is not None:
        r = r.schema(schema)
    return r.options(**{k: str(v) for k, v in options.items()})


def read_csv(spark: SparkSession, path, schema=None, multi_line: bool = False, null_marker: str | None = None,
             recursive: bool = False, glob: str | None = None, **options) -> DataFrame:
    """A1 / A2: header CSV; every column STRING unless a schema is given (no inference).

    ``multi_line=True`` allows quoted newlines inside a field (such a file is read by one task,
    so keep individual files moderate). ``glob`` is a cheap file-name pre-filter.
    """
    r = csv_reader(spark, schema, multi_line, null_marker, **options)
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.csv(path)


def with_file_path(df: DataFrame, name: str = "file", block_start: str | None = None) -> DataFrame:
    """The source file of every row (``_metadata.file_path``); optionally the split offset too."""
    out = df.withColumn(name, F.col("_metadata.file_path"))
    if block_start:
        out = out.withColumn(block_start, F.col("_metadata.file_block_start"))
    return out


def select_files(df: DataFrame, path_col: str = "file", prefix: str | None = None, suffix: str | None = None,
                 name_regex: str | None = None, exclude_regex: str | None = None, root: str | None = None) -> DataFrame:
    """Keep rows whose file path passes the tests.

    ``prefix`` is tested on the key below ``root`` (or on the whole path). ``name_regex`` is
    anchored at the start only, like a prefix match (``.*?/LOAD[0-9]+\\.csv`` also takes
    ``x/LOAD1.csv.gz`` and needs a ``/`` before ``LOAD``). ``exclude_regex`` likewise, e.g.
    ``.*_\\$folder\\$$`` for folder markers.
    """
    p = F.col(path_col)
    key = relative_to(p, root) if root else p
    cond = F.lit(True)
    if prefix:
        cond = cond & key.startswith(prefix)
    if suffix:
        cond = cond & p.endswith(suffix)
    if name_regex:
        cond = cond & key.rlike("\\A(?:" + name_regex + ")")
    if exclude_regex:
        cond = cond & ~key.rlike("\\A(?:" + exclude_regex + ")")
    return df.filter(cond)


def path_columns(df: DataFrame, root: str, path_col: str = "file", depth: int = 3,
                 names=("database", "table", "file_name")) -> DataFrame:
    """Split the key below ``root`` into ``database/table/file``; any other depth is flagged
    in ``bad_path`` (instead of stopping the run)."""
    key = relative_to(F.col(path_col), root)
    parts = key_parts(key)
    out = df.withColumn("key", key).withColumn("bad_path", F.size(parts) != depth)
    for i, n in enumerate(names):
        out = out.withColumn(n, F.when(~F.col("bad_path"), F.element_at(parts, i + 1)))
    return out
