"""J9 bulk_load: header CSV files laid out as ``<root>/<database>/<table>/<file>`` replace rows of
their table by key (last duplicate in file order wins), with a status per file."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.upsert import upsert
from tessera.session import scratch_path
from tessera.sources.catalog import from_rows
from tessera.sources.files import path_columns, read_csv

_ORDER = ["__file", "__block", "__pos"]
_RAGGED = "__ragged"
#: rows of a batch from which its narrow side of a join is hashed; up to here the planner broadcasts or sorts it
LARGE_BATCH = 1_000_000


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """All files below ``root`` (path and size only: file contents are not read)."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
            .select(F.col("path").alias("file"), F.col("length").alias("bytes")))


def read_table_files(spark: SparkSession, root: str, database: str, table: str, columns: Sequence[str]) -> DataFrame:
    """The rows of ``<root>/<database>/<table>/*`` as text, one header line skipped per file, each
    with its file, split offset and position (the file order used to pick the last duplicate)."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, _RAGGED]])
    folder = f"{root.rstrip('/')}/{database}/{table}"
    df = read_csv(spark, folder, schema=schema, multi_line=True, columnNameOfCorruptRecord=_RAGGED)
    return df.select("*", F.col("_metadata.file_path").alias("__file"),
                     F.col("_metadata.file_block_start").alias("__block"),
                     F.monotonically_increasing_id().alias("__pos"))


def typed_rows(raw: DataFrame, base_schema: T.StructType) -> DataFrame:
    """Text -> table types with ``try_cast``; ``__bad`` counts values that did not convert."""
    # a record with fields missing or to spare counts as a bad value too
    cols, bad = [], F.when(F.col(_RAGGED).isNotNull(), 1).otherwise(0)
    for f in base_schema.fields:
        txt = F.col(f"`{f.name}`")
        typed = txt.try_cast(f.dataType)
        cols.append(typed.alias(f.name))
        bad = bad + F.when(txt.isNotNull() & typed.isNull(), 1).otherwise(0)
    return raw.select(*cols, *_ORDER, bad.alias("__bad"))


def stage_table(spark: SparkSession, root: str, database: str, table: str, base: DataFrame) -> DataFrame:
    """The table's files parsed once: typed rows with their file, place and count of bad values, stored as Parquet.

    Counts, failed files and the batch all read this copy, so the CSV files are scanned a single time and every
    use sees the same rows.
    """
    path = scratch_path(spark, f"load-{database}-{table}")
    typed_rows(read_table_files(spark, root, database, table, base.columns), base.schema).write.parquet(path)
    return spark.read.parquet(path)


def file_counts(staged: DataFrame) -> DataFrame:
    """Rows and bad values of each staged file."""
    return staged.groupBy(F.col("__file").alias("file")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("__bad").alias("n_bad_values"))


def load_table(spark: SparkSession, root: str, database: str, table: str, base: DataFrame,
               keys: Sequence[str], ignore_errors: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """B9 for one table: returns (new table, per-file rows/bad-value counts).

    A file holding a value that does not convert to the table's type is not applied at all
    (like a failed load of that file), unless ``"bad values"`` is in ``ignore_errors``; then its
    rows load with nulls in place of the bad values. Other files load either way.
    """
    staged = stage_table(spark, root, database, table, base)
    hint = "shuffle_hash" if staged.count() > LARGE_BATCH else None
    per_file = file_counts(staged)
    loads = per_file if "bad values" in ignore_errors else per_file.filter("n_bad_values = 0")
    return upsert(base, placed(staged, loads), keys, order_by=["__place"], unique=True, hint=hint), per_file


def placed(staged: DataFrame, files: DataFrame) -> DataFrame:
    """The staged rows of these files with ``__place``, one number that grows in file order: the file's number by name, then
    the row's in its task (a file of these is never split). Carrying it is cheaper than the path."""
    # one row per file
    number = files.select(F.col("file").alias("__file"), (F.row_number().over(W.orderBy("file")) - 1).cast("long").alias("__number"))
    place = F.shiftleft("__number", 33).bitwiseOR(F.col("__pos").bitwiseAND(F.lit((1 << 33) - 1).cast("long")))
    return staged.join(F.broadcast(number), "__file").withColumn("__place", place).drop(*_ORDER, "__number", "__bad")


def load_status(spark: SparkSession, root: str, per_file: DataFrame | None,
                targets: Sequence[tuple[str, str]], ignore_errors: Sequence[str] = ()) -> DataFrame:
    """``(file, database, table, status, reason, n_rows)`` for every file under ``root``.

    A file at another depth than ``<database>/<table>/<file>``, for a table that is not a
    target, or with values that do not convert fails alone; the other files still load. Reasons
    listed in ``ignore_errors`` count as success.
    """
    files = path_columns(list_files(spark, root), root)
    target_rows = from_rows(spark, [(d, t) for d, t in targets], "database string, table string") \
        .withColumn("__known", F.lit(True))
    st = files.join(target_rows, ["database", "table"], "left")
    if per_file is not None:
        st = st.join(per_file, "file", "left")
    else:
        st = st.withColumn("n_rows", F.lit(None).cast("long")).withColumn("n_bad_values", F.lit(None).cast("long"))
    reason = (F.when(F.col("bad_path"), F.lit("bad path"))
               .when(F.col("__known").isNull(), F.lit("unknown table"))
               .when(F.coalesce(F.col("n_bad_values"), F.lit(0)) > 0, F.lit("bad values")))
    if ignore_errors:
        reason = F.when(reason.isin(list(ignore_errors)), F.lit(None).cast("string")).otherwise(reason)
    return st.select("file", "database", "table",
                     F.when(reason.isNull(), F.lit("Success")).otherwise(F.lit("Failed")).alias("status"),
                     reason.alias("reason"), "n_rows", "n_bad_values")


def bulk_load(spark: SparkSession, root: str, targets: Mapping[tuple[str, str], tuple[DataFrame, Sequence[str]]],
              ignore_errors: Sequence[str] = ()):
    """Whole job: ``targets`` maps (database, table) -> (current table, key columns).

    Returns ``({(db, table): new table}, status)``.
    """
    results, per_files = {}, None
    for (db, t), (base, keys) in targets.items():
        res, pf = load_table(spark, root, db, t, base, keys, ignore_errors)
        results[(db, t)] = res
        per_files = pf if per_files is None else per_files.unionByName(pf)
    return results, load_status(spark, root, per_files, list(targets), ignore_errors)


# Test-data shape: a change batch for ``orders``. Open orders get two versions (the later one
# wins), pending orders are copied under new keys above the current maximum.

def orders_changes(orders: DataFrame) -> DataFrame:
    cols = orders.columns
    open_o = orders.filter(F.col("o_orderstatus") == "O")
    v1 = open_o.withColumn("o_orderstatus", F.lit("P")).withColumn("__seq", F.lit(1))
    v2 = open_o.withColumn("o_orderstatus", F.lit("F")) \
               .withColumn("o_totalprice", F.col("o_totalprice") + F.lit(1.0)).withColumn("__seq", F.lit(2))
    next_key = orders.select(F.max("o_orderkey") + 1).scalar()
    new = orders.filter(F.col("o_orderstatus") == "P") \
                .withColumn("o_orderkey", F.col("o_orderkey") + next_key) \
                .withColumn("o_orderstatus", F.lit("O")).withColumn("__seq", F.lit(1))
    return v1.unionByName(v2).unionByName(new).select(*cols, "__seq")


def write_changes(changes: DataFrame, root: str, database: str, table: str, keys: Sequence[str]) -> None:
    """Lay a change batch out as CSV files: all versions of a key in one file, in version order."""
    from tessera.sinks.files import write_csv

    out = changes.repartition(*keys).sortWithinPartitions(*keys, "__seq").drop("__seq")
    write_csv(out, f"{root.rstrip('/')}/{database}/{table}", mode="append")


def landing_with_failures(orders: DataFrame, root: str) -> None:
    """Test-data shape: a landing folder with good files, files with values that do not convert, files one level too
    deep and files of a table that is no target."""
    from tessera.sinks.files import write_csv

    cols = [F.col(c).cast("string").alias(c) for c in orders.columns]
    broken = orders.select(*[F.concat(F.lit("about "), c).alias("o_totalprice") if n == "o_totalprice" else c for n, c in zip(orders.columns, cols, strict=True)])
    root = root.rstrip("/")
    write_csv(orders.filter("o_orderstatus = 'F'"), f"{root}/tpch/orders", mode="append", single_file=True)
    write_csv(broken.filter("o_orderstatus = 'O' and o_orderpriority like '1%'"), f"{root}/tpch/orders", mode="append", single_file=True)
    write_csv(orders.filter("o_orderstatus = 'P'"), f"{root}/tpch/orders/deeper", single_file=True)
    write_csv(orders.filter("o_orderstatus = 'P'"), f"{root}/tpch/nobody", single_file=True)
