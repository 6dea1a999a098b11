"""Aggregations (F1-F10, G3). All are hash aggregates with map-side partial aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions._util import int_div
from tessera.session import scratch_path


def row_count(df: DataFrame, name: str = "n_rows") -> DataFrame:
    """F1 as a one-row DataFrame."""
    return df.agg(F.count(F.lit(1)).alias(name))


def audit_files(df: DataFrame, key: str, file_col: str = "file", with_total: bool = True) -> DataFrame:
    """per file, total rows, rows with a null key and valid rows, in one scan.

    ``df`` must carry the file column (see ``sources.with_file_path``). With ``with_total`` a
    grand-total row (``is_total``, null file) is added from the files' own counts: rows are counted once, and only the
    row for each file is used again.
    """
    out = df.groupBy(file_col).agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(F.col(key).isNull()).alias("null_rows"))
    if with_total:
        # a file's row stands for itself and for the total
        copies = F.explode(F.array(F.struct(F.col(file_col).alias("f"), F.lit(False).alias("t")), F.struct(F.lit(None).cast(df.schema[file_col].dataType).alias("f"), F.lit(True).alias("t"))))
        out = (out.select(copies.alias("x"), "total_rows", "null_rows").groupBy(F.col("x.f").alias(file_col), F.col("x.t").alias("is_total"))
               .agg(F.sum("total_rows").alias("total_rows"), F.sum("null_rows").alias("null_rows")))
    out = out.withColumn("valid_rows", F.col("total_rows") - F.col("null_rows"))
    return out.select(file_col, "total_rows", "null_rows", "valid_rows", *(["is_total"] if with_total else []))


def daily_average(df: DataFrame, entity: str, cls: str, ts: str, value, name: str = "average") -> DataFrame:
    """Average per entity, class and tumbling one-day window (``window_start`` kept)."""
    v = F.col(value) if isinstance(value, str) else value
    return (df.groupBy(entity, cls, F.window(ts, "1 day").alias("w"))
              .agg(F.avg(v).alias(name))
              .select(entity, cls, F.col("w.start").alias("window_start"), name))


def pivot_classes(df: DataFrame, entity: str, cls: str, value: str, classes: Sequence[str],
                  time_col: str | None = "window_start", fill=0) -> DataFrame:
    """class values as columns (fixed list: no extra pass to find them), missing -> ``fill``.

    Only the first data point per (entity, class) is used: the earliest ``time_col`` (without one, the least).
    """
    if time_col and time_col in df.columns:
        agg = F.min_by(F.col(value), F.col(time_col))
    else:
        agg = F.min(F.col(value))
    out = df.groupBy(entity).pivot(cls, list(classes)).agg(agg)
    return out.na.fill(fill, subset=list(classes)) if fill is not None else out


def row_total(cols: Sequence[str]) -> Column:
    """horizontal sum of columns."""
    total = F.col(cols[0])
    for c in cols[1:]:
        total = total + F.col(c)
    return total


def class_totals(df: DataFrame, classes: Sequence[str], total_name: str = "Total") -> DataFrame:
    """totals per class plus the grand total (one row)."""
    return df.agg(*[F.sum(c).alias(c) for c in classes], F.sum(row_total(classes)).alias(total_name))


def group_ids(edges: DataFrame, group: str, kind: str, item: str, keep_duplicates: bool = False,
              out: str = "resources", chunk_size: int | None = 1_000_000) -> DataFrame:
    """F8: per group, a map ``kind -> sorted ids`` in column ``out``, plus a ``part`` number.

    One plan and one shape at every size: the ids of a (group, kind), in order, fill parts of ``chunk_size``
    (part 0 the first ``chunk_size`` ids, and so on), one row for each part of a group. An ordinary group is one
    row with ``part = 0``; no id is dropped and no row or task gathers more than ``chunk_size`` ids of a kind.
    ``chunk_size=None`` always gives one row per group.

    Edges are made distinct by all three columns (a hot group is spread by id and reduced map-side), then dealt by
    range of (group, kind, id): a range holds one run of ids of a group, so a group's runs are few and in
    order. A run's first position is the number of ids in the group's earlier runs, one number for each run; runs are cut
    where parts begin and the pieces of a part are put together. The runs are written to the shared scratch
    folder, so that both uses see the same ones.
    """
    e = edges if keep_duplicates else edges.dropDuplicates([group, kind, item])
    # ids become text only after de-duplication (cheaper keys for the shuffle)
    e = e.select(F.col(group).cast("string").alias(group), F.col(kind), F.col(item).cast("string").alias(item))
    runs = (e.repartitionByRange(group, kind, item).groupBy(group, kind, F.spark_partition_id().alias("__run"))
            .agg(F.array_sort(F.collect_list(item)).alias("ids")))
    if chunk_size is None:
        parts = (runs.groupBy(group, kind).agg(F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids"))
                 .withColumn("part", F.lit(0).cast("long")))
    else:
        path = scratch_path(edges.sparkSession, "id-runs")
        runs.withColumn("__n", F.size("ids").cast("long")).write.parquet(path)
        runs = edges.sparkSession.read.parquet(path)
        earlier = Window.partitionBy(group, kind).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
        begin = runs.select(group, kind, "__run", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__begin"))
        same = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (group, kind, "__run")]
        chunk = F.lit(chunk_size).cast("long")
        # a run that begins a group needs no look-up: most groups are one run
        placed = runs.alias("r").join(begin.filter("__begin > 0").alias("b"), same, "left").select(
            *[F.col(f"r.{c}").alias(c) for c in (group, kind, "__run", "ids", "__n")], F.coalesce("b.__begin", F.lit(0).cast("long")).alias("__begin"))
        cut = placed.withColumn("part", F.explode(F.sequence(int_div("__begin", chunk), int_div(F.col("__begin") + F.col("__n") - 1, chunk))))
        first = F.greatest(F.lit(0).cast("long"), F.col("part") * chunk - F.col("__begin"))
        last = F.least(F.col("__n"), (F.col("part") + 1) * chunk - F.col("__begin"))
        pieces = cut.select(group, kind, "part", "__run", F.slice("ids", (first + 1).cast("int"), (last - first).cast("int")).alias("ids"))
        parts = pieces.groupBy(group, kind, "part").agg(
            F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__run", "ids"))), lambda x: x["ids"])).alias("ids"))
    return parts.groupBy(group, "part").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(kind), F.col("ids"))))).alias(out))


def status_counts(status: DataFrame, status_col: str = "status") -> DataFrame:
    """F9 summary: number of files per load status."""
    return status.groupBy(status_col).agg(F.count(F.lit(1)).alias("n_files"))


def catalog_document(columns: DataFrame, db: str = "database", table: str = "table", pos: str = "position",
                     column: str = "column", type_col: str = "mapped_type") -> DataFrame:
    """per (database, table), columns in ordinal order and a ``column -> type`` map."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos), F.col(column), F.col(type_col))))
    return (columns.groupBy(db, table).agg(ordered.alias("__cols"))
            .select(db, table,
                    F.transform("__cols", lambda s: s[column]).alias("columns"),
                    F.map_from_arrays(F.transform("__cols", lambda s: s[column]),
                                      F.transform("__cols", lambda s: s[type_col])).alias("schema")))
