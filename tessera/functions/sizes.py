"""Human-readable byte sizes with integer arithmetic (identical in Spark and SQL engines)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions._util import as_col, int_div

# Unit names and their sizes, base 1000.
SIZE_UNITS = [("KB", 10**3), ("MB", 10**6), ("GB", 10**9), ("TB", 10**12), ("PB", 10**15)]


def human_size(col) -> Column:
    """Bytes below 1000 as ``<n>B``; otherwise one decimal of the largest unit not above the value.

    The input is cast to BIGINT first (callers should pass integer byte counts). 999,999 gives
    ``1000.0KB`` (no carry), 10**15 and above use PB. Written as a unit lookup rather than one
    branch per unit, which keeps the generated code small.
    """
    n = as_col(col).cast("long")
    k = F.lit(0)
    for _, unit in SIZE_UNITS:
        k = k + (n >= F.lit(unit)).cast("int")
    pick = k + F.lit(1)
    half = F.element_at(F.array(F.lit(0), *[F.lit(u // 20) for _, u in SIZE_UNITS]), pick)
    tenth = F.element_at(F.array(F.lit(1), *[F.lit(u // 10) for _, u in SIZE_UNITS]), pick)
    name = F.element_at(F.array(*[F.lit(x) for x in ["B"] + [nm for nm, _ in SIZE_UNITS]]), pick)
    tenths = int_div(n + half, tenth)
    one_decimal = F.concat(int_div(tenths, 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), name)
    return F.when(k == 0, F.concat(n.cast("string"), F.lit("B"))).otherwise(one_decimal)
