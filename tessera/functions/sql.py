"""The column functions as SQL functions (``CREATE TEMPORARY FUNCTION ... RETURN expr``).

SQL functions are expanded into plain expressions by the analyzer, so queries that call them
keep whole-stage code generation; no Python worker is involved.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tessera.functions.sizes import SIZE_UNITS
from tessera.functions.text import EMAIL_PATTERN
from tessera.functions.types import TYPE_RULES


def _human_size_sql(n: str) -> str:
    parts = [f"CASE WHEN {n} < 1000 THEN concat(CAST({n} AS STRING), 'B')"]
    for i, (name, unit) in enumerate(SIZE_UNITS):
        t = f"(({n} + {unit // 20}) div {unit // 10})"
        text = f"concat(CAST({t} div 10 AS STRING), '.', CAST({t} % 10 AS STRING), '{name}')"
        cond = f"{n} < {SIZE_UNITS[i + 1][1]}" if i + 1 < len(SIZE_UNITS) else "true"
        parts.append(f"WHEN {cond} THEN {text}")
    return " ".join(parts) + " END"


def _map_type_sql(t: str) -> str:
    parts = ["CASE"]
    for kind, needle, result in TYPE_RULES:
        cond = f"contains({t}, '{needle}')" if kind == "contains" else f"{t} RLIKE '{needle}'"
        parts.append(f"WHEN {cond} THEN '{result}'")
    args = rf"split(regexp_extract({t}, r'decimal\(([^)]*)\)', 1), ',')"
    p = f"try_cast(trim(element_at({args}, 1)) AS INT)"
    s = f"coalesce(try_cast(trim(get({args}, 1)) AS INT), 0)"
    parts.append(rf"WHEN {t} RLIKE r'decimal\(([^)]*)\)' AND {p} IS NOT NULL "
                 f"THEN concat('decimal(', CAST({p} AS STRING), ',', CAST({s} AS STRING), ')')")
    parts.append("ELSE 'string' END")
    return " ".join(parts)


def _hash_email_sql(s: str) -> str:
    pattern = rf"\A{EMAIL_PATTERN}\n?\z"
    return (rf"CASE WHEN {s} RLIKE r'{pattern}' THEN concat(sha2(regexp_extract({s}, r'\A([^\n]*)', 1), 256), "
            f"CASE WHEN endswith({s}, char(10)) THEN char(10) ELSE '' END) ELSE {s} END")


FUNCTIONS = {
    "hash_email": ("s STRING", "STRING", _hash_email_sql("s")),
    "hash_value": ("s STRING", "STRING", "sha2(s, 256)"),
    "newlines_to_space": ("s STRING", "STRING", "replace(s, char(10), ' ')"),
    "human_size": ("n BIGINT", "STRING", _human_size_sql("n")),
    "map_sql_type": ("t STRING", "STRING", _map_type_sql("t")),
    "is_email": ("s STRING", "BOOLEAN", rf"s RLIKE r'\A(?:{EMAIL_PATTERN})\z'"),
}


def register(spark: SparkSession) -> list[str]:
    """Create the temporary SQL functions in this session; returns their names."""
    for name, (params, returns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {returns} RETURN {body}")
    return list(FUNCTIONS)
