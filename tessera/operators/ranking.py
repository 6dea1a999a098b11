"""Sorting and ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.joins import add_row_index


def ranked(df: DataFrame, by: str, tie: Sequence[str], name: str = "Row", descending: bool = True) -> DataFrame:
    """G1 + G2: sort by ``by`` (largest first by default), ties broken by ``tie`` ascending, and
    number the rows 1..n as BIGINT.

    The numbering is the distributed row index (range-partitioned sort, per-partition offsets),
    not a ``row_number()`` over an unpartitioned window, so the number of ranked rows is not
    limited by one task.
    """
    primary = F.col(by).desc() if descending else F.col(by).asc()
    order = [primary] + [F.col(t).asc() for t in tie]
    out = add_row_index(df, name, order_by=order)
    return out.withColumn(name, F.col(name) + F.lit(1))
