from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def int_div(a, b) -> Column:
    """Integer division (SQL ``div``), exact for BIGINT."""
    a = as_col(a)
    b = b if isinstance(b, Column) else F.lit(b)
    return F.call_function("div", a, b)
