"""Catalog and in-memory sources."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS_SCHEMA = T.StructType([
    T.StructField("database", T.StringType(), False),
    T.StructField("table", T.StringType(), False),
    T.StructField("position", T.IntegerType(), False),
    T.StructField("column", T.StringType(), False),
    T.StructField("type", T.StringType(), True),
])


def read_table(spark: SparkSession, database: str | None, table: str) -> DataFrame:
    """A3: a catalog table (the catalog resolves the storage path)."""
    return spark.table(f"`{database}`.`{table}`" if database else f"`{table}`")


def from_rows(spark: SparkSession, rows: Sequence, schema) -> DataFrame:
    """A4 / A5: small inline data (tests, lookups); ``schema`` is a list of names or a StructType."""
    return spark.createDataFrame(list(rows), schema)


def columns_of_frames(spark: SparkSession, database: str, frames: Iterable[tuple[str, DataFrame]]) -> DataFrame:
    """A10 source for lake tables: ``(database, table, position, column, type)`` from DataFrame schemas.

    Only schema metadata is handled here (one row per column), never table rows.
    """
    rows = []
    for table, df in frames:
        for pos, f in enumerate(df.schema.fields, start=1):
            rows.append((database, table, pos, f.name, f.dataType.simpleString()))
    return spark.createDataFrame(rows, COLUMNS_SCHEMA)


def columns_of_catalog(spark: SparkSession, database: str) -> DataFrame:
    """A10 source from the session catalog."""
    frames = [(t.name, spark.table(f"`{database}`.`{t.name}`")) for t in spark.catalog.listTables(database)
              if not t.isTemporary]  # session views are listed with every database
    return columns_of_frames(spark, database, frames)


def columns_of(columns: DataFrame, database: str) -> DataFrame:
    """A10: (table, position, column, type) rows of one database, one scan for all tables."""
    return columns.filter(F.col("database") == database).select("database", "table", "position", "column", "type")


def tables_of(columns: DataFrame, database: str) -> DataFrame:
    """The table names of one database."""
    return columns.filter(F.col("database") == database).select("table").distinct()
