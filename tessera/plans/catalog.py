"""J8 schema_catalog: per database, the tables, their columns in order and mapped types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.types import map_sql_type
from tessera.operators.aggregates import catalog_document
from tessera.sources.catalog import columns_of


def schema_catalog(columns: DataFrame, database: str) -> DataFrame:
    """A9/A10 + C13: ``(database, table, position, column, mapped_type)`` for one database, one scan."""
    return columns_of(columns, database).select("database", "table", "position", "column",
                                                map_sql_type("type").alias("mapped_type"))


def schema_document(catalog: DataFrame) -> DataFrame:
    """F10 + B8: per table, the ordered column list and ``{column: type}`` as JSON text."""
    doc = catalog_document(catalog)
    return doc.select("database", "table", F.size("columns").alias("n_columns"),
                      F.array_join("columns", ",").alias("columns"),
                      F.to_json("schema").alias("schema"))
