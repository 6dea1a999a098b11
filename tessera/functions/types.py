"""Map a source database type text to a target type name.

The rules are applied in order and the first one that fits wins, which yields some quirks that
are kept on purpose: ``timestamp``, ``float``, ``json`` and ``time`` give ``string``; ``point``
and ``enum(...)`` (they contain ``int``) give ``int``; ``set('date')`` gives ``date``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions._util import as_col

# Fixed values: (kind, needle, result) in the order they are tried.
TYPE_RULES = [
    ("contains", "datetime", "timestamp"),
    ("regex", "int.*unsigned", "long"),
    ("contains", "bigint", "long"),
    ("contains", "int", "int"),
    ("contains", "date", "date"),
    ("contains", "char", "string"),
    ("contains", "text", "string"),
    ("contains", "double", "float"),
]
_DECIMAL_ARGS = "decimal\\(([^)]*)\\)"


def map_sql_type(col) -> Column:
    t = as_col(col)
    expr = None
    for kind, needle, result in TYPE_RULES:
        cond = t.contains(needle) if kind == "contains" else t.rlike(needle)
        expr = F.when(cond, F.lit(result)) if expr is None else expr.when(cond, F.lit(result))
    args = F.split(F.regexp_extract(t, _DECIMAL_ARGS, 1), ",")
    precision = F.trim(F.element_at(args, 1)).try_cast("int")
    # one argument only (decimal(10)) means scale 0
    scale = F.coalesce(F.trim(F.get(args, 1)).try_cast("int"), F.lit(0))
    decimal = F.concat(F.lit("decimal("), precision.cast("string"), F.lit(","), scale.cast("string"), F.lit(")"))
    return expr.when(t.rlike(_DECIMAL_ARGS) & precision.isNotNull(), decimal).otherwise(F.lit("string"))
