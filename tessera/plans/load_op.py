"""J2 add_load_op: give initial-load CSV files (``.../LOAD<n>.csv``) the change files' leading
``Op`` column (value ``I``), each landing file consumed exactly once."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.paths import key_parts, relative_to
from tessera.operators.sets import align_union
from tessera.sinks.files import write_csv
from tessera.session import scratch_path
from tessera.sources.files import read_csv
from tessera.streaming.ingest import Files, consume_once, plain

# Fixed value: the load-file rule (matched from the start of the key, no end anchor).
LOAD_FILE_PATTERN = ".*?/LOAD[0-9]+\\.csv"
#: files that a task of the in-place variant has open at a time
OPEN_FILES = 64
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def load_rows(spark: SparkSession, paths: Sequence[str], landing: str, columns: Sequence[str]) -> DataFrame:
    """The rows of these load files (``.csv.gz`` and the part files of a folder named like one too), ``Op='I'`` first.

    ``database``/``table`` are the first two folders of a load file at ``<database>/<table>/<load file>`` and null
    at another depth; ``source_file`` is the file itself, ``load_file`` the path of the load file or folder it belongs to.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = read_csv(spark, [plain(p) for p in paths], schema=schema)
    file = F.col("_metadata.file_path")
    # the load file's own place, also when it is a folder of part files
    key = F.regexp_extract(relative_to(file, landing), LOAD_FILE_PATTERN, 0)
    folders = key_parts(key)
    at_table = F.size(folders) == 3
    shaped = rows.select(*[F.col(f"`{c}`") for c in columns], F.when(at_table, F.element_at(folders, 1)).alias("database"),
                         F.when(at_table, F.element_at(folders, 2)).alias("table"), file.alias("source_file"),
                         F.regexp_extract(file, "^(.*?/LOAD[0-9]+\\.csv)", 1).alias("load_file"))
    return align_union(shaped, op_col="Op", op_value="I")


def add_load_op(spark: SparkSession, landing: str, out: str, columns: Sequence[str], checkpoint: str,
                archive_dir: str | None = None, delete: bool = False, max_files: int | None = None) -> None:
    """Run once over everything new, at any depth: output CSV under ``out/batch=<name>/database=<db>/table=<t>/`` (header on).

    A batch that is repeated after a failure replaces its own folder. ``archive_dir`` moves consumed load files away,
    ``delete`` removes them; nothing else in ``landing`` is touched.
    """
    def write_batch(paths: list[str], name: str) -> None:
        rows = load_rows(spark, paths, landing, columns).drop("source_file", "load_file")
        write_csv(rows, f"{out.rstrip('/')}/batch={name}", partition_by=["database", "table"])

    consume_once(spark, landing, LOAD_FILE_PATTERN, checkpoint, write_batch, archive_dir, delete, max_files)


@contextmanager
def _open_files(spark: SparkSession) -> Iterator[None]:
    """Within, a task that writes by folder keeps several files open (``OPEN_FILES``; it sorts what is left beyond them) instead
    of sorting all of its rows, which are those of a whole load file with ``single_file``."""
    before = spark.conf.get(_WRITERS, None)
    spark.conf.set(_WRITERS, str(OPEN_FILES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_WRITERS)
        else:
            spark.conf.set(_WRITERS, before)


def add_load_op_in_place(spark: SparkSession, landing: str, columns: Sequence[str], checkpoint: str, archive_dir: str | None = None,
                         delete: bool = False, max_files: int = 1000, single_file: bool = False) -> None:
    """B6 variant: each load file's rows go back beside it, as ``<folder>/op-<load file>/part-*.csv``, a name
    the load-file rule does not match, so they are not consumed again.

    A batch is one write into the scratch folder, partitioned by source file, however many files it holds; then each file's
    folder is moved to its place (at most ``max_files`` renames). The name depends on the file alone: a
    replayed batch, or a run with a new checkpoint, replaces the same file's output and no other's. ``single_file`` writes
    one file for each (B5), each by one task.
    """
    files = Files(spark)

    def write_batch(paths: list[str], name: str) -> None:
        rows = load_rows(spark, paths, landing, columns)
        staged = scratch_path(spark, "in-place")
        rows = rows.select("Op", *[F.col(f"`{c}`") for c in columns], F.sha2("source_file", 256).alias("__of"))
        with _open_files(spark):
            write_csv(rows.repartition("__of") if single_file else rows, staged, partition_by="__of")
        # one staged folder for each file that has rows; a path comes with or without escapes from the reader
        source = {hashlib.sha256(form.encode()).hexdigest(): p for p in paths for form in (p, files.escaped(p))}
        for name in files.names(staged):
            if name.startswith("__of="):
                folder, own = re.match(f"(.*?)/({LOAD_FILE_PATTERN.removeprefix('.*?/')}.*)", source[name.removeprefix("__of=")]).groups()
                to = f"{folder}/op-{own.replace('/', '-')}"
                files.delete(to)
                files.move(f"{staged}/{name}", to)
        files.delete(staged)

    consume_once(spark, landing, LOAD_FILE_PATTERN, checkpoint, write_batch, archive_dir, delete, max_files)


def read_output(spark: SparkSession, out: str) -> DataFrame:
    """The output as written so far."""
    return read_csv(spark, out).drop("batch")


# Test-data shape ---------------------------------------------------------------------------

def put_file(df: DataFrame, path: str, **options) -> None:
    """The rows as one CSV file of exactly this name."""
    files, staged = Files(df.sparkSession), scratch_path(df.sparkSession, "put-file")
    write_csv(df.coalesce(1), staged, **options)
    part = next(n for n in files.names(staged) if n.startswith("part-"))
    files.move(f"{staged}/{part}", path)
    files.delete(staged)


def orders_landing(orders: DataFrame, root: str, first: bool) -> None:
    """``orders`` as load files of every kind at several depths, in two deliveries, beside files that are none."""
    even = F.col("o_orderkey") % 2 == 0
    if first:
        put_file(orders.filter("o_orderstatus = 'F'"), f"{root}/tpch/orders/LOAD00000001.csv")
        put_file(orders.filter("o_orderstatus = 'P'"), f"{root}/far/below/tpch/orders/LOAD2.csv")
        put_file(orders.limit(1), f"{root}/tpch/orders/LOAD5_backup.csv")
    else:
        write_csv(orders.filter("o_orderstatus = 'O'").filter(even), f"{root}/tpch/orders/LOAD3.csv")
        put_file(orders.filter("o_orderstatus = 'O'").filter(~even), f"{root}/tpch/LOAD4.csv.gz", compression="gzip")
        put_file(orders_changes(orders), f"{root}/tpch/orders/20240102-changes.csv")
        put_file(orders.limit(0), f"{root}/tpch/orders/LOAD6.csv")


def orders_changes(orders: DataFrame) -> DataFrame:
    """A change file: the same columns with an operation before them."""
    return orders.filter("o_orderstatus = 'F'").select(F.lit("U").alias("Op"), *orders.columns)
