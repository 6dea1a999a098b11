"""A profile of a DataFrame as a DataFrame (one aggregation pass)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile(df: DataFrame) -> DataFrame:
    """One row per column: ``position, column, type, non_null, nulls`` (plus the row count)."""
    cols = df.columns
    row = df.agg(F.count(F.lit(1)).alias("__rows"),
                 *[F.count(F.col(f"`{c}`")).alias(f"__c{i}") for i, c in enumerate(cols)])
    entries = [F.struct(F.lit(i + 1).alias("position"), F.lit(c).alias("column"),
                        F.lit(df.schema[c].dataType.simpleString()).alias("type"),
                        F.col(f"__c{i}").alias("non_null"),
                        (F.col("__rows") - F.col(f"__c{i}")).alias("nulls"))
               for i, c in enumerate(cols)]
    return row.select(F.col("__rows").alias("rows"), F.explode(F.array(*entries)).alias("p")) \
              .select("p.position", "p.column", "p.type", "p.non_null", "p.nulls", "rows")
