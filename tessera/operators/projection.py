"""Projection operators (C1-C5, C9, C10, C14). DataFrame in, DataFrame out; narrow, no shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Short type names as written in mapping lists -> Spark SQL type text.
_TYPE_ALIASES = {"long": "bigint", "integer": "int", "str": "string", "bool": "boolean"}


def sql_type(name: str) -> str:
    return _TYPE_ALIASES.get(name.lower(), name)


def add_constant(df: DataFrame, name: str, value, first: bool = True) -> DataFrame:
    """C1 (+C2): a literal column, placed first by default."""
    others = [F.col(f"`{c}`") for c in df.columns if c != name]
    lit = F.lit(value).alias(name)
    return df.select(lit, *others) if first else df.select(*others, lit)


def apply_mapping(df: DataFrame, mappings: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """Keep, rename and cast the listed columns only; a failed cast gives null (``try_cast``),
    and a listed column that the input lacks gives a column of nulls. Names are compared as the session
    does (``spark.sql.caseSensitive``)."""
    out = []
    exact = df.sparkSession.conf.get("spark.sql.caseSensitive", "false") == "true"
    schema = {f.name if exact else f.name.lower(): f.dataType for f in df.schema.fields}
    for src, _src_type, dst, dst_type in mappings:
        c = F.col(f"`{src}`")
        src = src if exact else src.lower()
        target = sql_type(dst_type)
        if src not in schema:  # a field absent from the input comes out as nulls of the target type
            out.append(F.lit(None).cast(target).alias(dst))
        elif schema[src].simpleString() == target:
            out.append(c.alias(dst))
        else:
            out.append(c.try_cast(target).alias(dst))
    return df.select(*out)


def rename_all(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """C4: positional rename of every column."""
    if len(names) != len(df.columns):
        raise ValueError(f"rename_all: {len(df.columns)} columns, {len(names)} names")
    return df.toDF(*names)


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """Drop every column of these names (both join sides' copies)."""
    return df.drop(*names)


def _without_void(dt: T.DataType) -> T.DataType | None:
    """The type without its void fields; None where nothing else is left (void, an array or map of it, a struct of it)."""
    if isinstance(dt, T.NullType):
        return None
    if isinstance(dt, T.StructType):
        fields = [(f, _without_void(f.dataType)) for f in dt.fields]
        kept = [T.StructField(f.name, inner, f.nullable, f.metadata) for f, inner in fields if inner is not None]
        return T.StructType(kept) if kept or not dt.fields else None
    if isinstance(dt, T.ArrayType):
        inner = _without_void(dt.elementType)
        return None if inner is None else T.ArrayType(inner, dt.containsNull)
    if isinstance(dt, T.MapType):
        key, value = _without_void(dt.keyType), _without_void(dt.valueType)
        return None if key is None or value is None else T.MapType(key, value, dt.valueContainsNull)
    return dt


def _reshaped(col: Column, src: T.DataType, dst: T.DataType) -> Column:
    """The value with the fields of ``dst`` only (nulls stay null at every level)."""
    if src == dst:
        return col
    if isinstance(src, T.StructType):
        parts = [_reshaped(col.getField(f.name), src[f.name].dataType, f.dataType).alias(f.name) for f in dst.fields]
        return F.when(col.isNotNull(), F.struct(*parts))
    if isinstance(src, T.ArrayType):
        return F.transform(col, lambda x: _reshaped(x, src.elementType, dst.elementType))
    if src.keyType == dst.keyType:
        return F.transform_values(col, lambda k, v: _reshaped(v, src.valueType, dst.valueType))
    entries = F.transform(F.map_entries(col), lambda e: F.struct(_reshaped(e["key"], src.keyType, dst.keyType).alias("key"),
                                                                 _reshaped(e["value"], src.valueType, dst.valueType).alias("value")))
    return F.map_from_entries(entries)


def drop_null_fields(df: DataFrame, data: bool = False) -> DataFrame:
    """Remove fields of NullType, at every depth of structs, arrays and maps.

    An array or a map of nothing but such fields, and a struct made only of them, go too. Map keys that differ only in a
    removed field become one key, which ``map_from_entries`` refuses or resolves as the session's map-key policy says.

    With ``data=True`` also remove top-level columns holding no value at all; that costs one
    aggregation pass returning a single row of per-column counts.
    """
    cols = []
    for f in df.schema.fields:
        target = _without_void(f.dataType)
        if target is not None:
            cols.append(_reshaped(F.col(f"`{f.name}`"), f.dataType, target).alias(f.name))
    out = df.select(*cols)
    if data and out.columns:
        counts = out.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in out.columns]).first().asDict()
        keep = [c for c in out.columns if counts[c] > 0]
        out = out.select(*[F.col(f"`{c}`") for c in keep])
    return out


def make_struct(df: DataFrame, name: str, types: Iterable[str] = ("long", "string")) -> DataFrame:
    """A column of mixed content -> struct with one field per type.

    A value goes into the first listed type that can take it (``try_cast``); the ``string`` field holds
    the original text where no typed field could. The other fields are null.
    """
    c = F.col(f"`{name}`")
    types = list(types)
    fields, taken = [], F.lit(False)
    for t in types:
        if sql_type(t) != "string":
            expr = c.try_cast(sql_type(t))
            fields.append(F.when(~taken, expr).alias(t))
            taken = taken | expr.isNotNull()
    if any(sql_type(t) == "string" for t in types):
        fields.append(F.when(~taken, c.cast("string")).alias("string"))
    return df.withColumn(name, F.struct(*fields))


def fill_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """C14: default values for missing (null) fields."""
    return df.na.fill(defaults)
