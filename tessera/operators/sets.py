"""Set operations (H1-H3): edge unions, distinct edges, aligning load files with change files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.projection import add_constant


def edges_from(df: DataFrame, item, kind: str, groups, group: str = "group_id", item_name: str = "item_id",
               kind_name: str = "kind", as_string: bool = True) -> DataFrame:
    """One edge ``(group, kind, item)`` per group id named by a resource row.

    ``groups`` is a column (or name) holding either one group id or an array of group ids;
    arrays are exploded (a null array contributes nothing), scalar nulls are dropped.
    ``as_string=False`` keeps the ids' own types (cheaper to de-duplicate; ``group_ids``
    turns them into text after de-duplication) when all sources share them.
    """
    g = F.col(groups) if isinstance(groups, str) else groups
    it = F.col(item) if isinstance(item, str) else item
    dtype = df.select(g).schema.fields[0].dataType
    if isinstance(dtype, T.ArrayType):
        out = df.select(F.explode(g).alias(group), F.lit(kind).alias(kind_name), it.alias(item_name))
    else:
        out = df.select(g.alias(group), F.lit(kind).alias(kind_name), it.alias(item_name))
    out = out.filter(F.col(group).isNotNull() & F.col(item_name).isNotNull())
    if not as_string:
        return out
    return out.select(F.col(group).cast("string").alias(group), kind_name,
                      F.col(item_name).cast("string").alias(item_name))


def ids_of(structs, field: str) -> Column:
    """Array of structs -> array of one field (``SecurityGroups[].GroupId``)."""
    c = F.col(structs) if isinstance(structs, str) else structs
    return F.transform(c, lambda s: s[field])


def nested_ids(outer, inner: str, field: str) -> Column:
    """Array of structs of arrays of structs -> flat array of ids (``NetworkInterfaces[].Groups[].GroupId``)."""
    c = F.col(outer) if isinstance(outer, str) else outer
    return F.flatten(F.transform(c, lambda o: F.transform(o[inner], lambda s: s[field])))


def ids_at(schema: T.StructType, path: str) -> Column:
    """The ids at a path as one array of text: names separated by dots, ``[]`` after each array's.

    ``Owner`` is a scalar, ``Extra[]`` an array of ids, ``Groups[].GroupId`` one of structs, and
    ``NetworkInterfaces[].Groups[].GroupId`` goes two levels down. A missing top-level field, and nulls at any level, give nothing.
    """
    def walk(value: Column, rest: list[str], is_array: bool) -> Column:
        if is_array:
            inner = F.flatten(F.transform(value, lambda x: walk(x, rest, False)))
            return F.coalesce(inner, F.array().cast("array<string>"))
        if not rest:
            return F.array(value.cast("string"))
        head, *more = rest
        return walk(value.getField(head.removesuffix("[]")), more, head.endswith("[]"))

    head, *more = path.split(".")
    name = head.removesuffix("[]")
    if name not in schema.names:
        return F.array().cast("array<string>")
    return walk(F.col(f"`{name}`"), more, head.endswith("[]"))


def edges_at(df: DataFrame, item, kind: str, paths: Iterable[str], group: str = "group_id", item_name: str = "item_id",
             kind_name: str = "kind") -> DataFrame:
    """H1 over nested resources: one edge for each different id that a resource names at any of the paths, in one scan."""
    it = F.col(item) if isinstance(item, str) else item
    ids = F.array_distinct(F.concat(*[ids_at(df.schema, p) for p in paths]))
    out = df.select(F.explode(ids).alias(group), F.lit(kind).alias(kind_name), it.cast("string").alias(item_name))
    return out.filter(F.col(group).isNotNull() & F.col(item_name).isNotNull())


def union_edges(parts: Iterable[DataFrame]) -> DataFrame:
    """H1: one edge list from many sources."""
    parts = list(parts)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def distinct_edges(edges: DataFrame, cols=None) -> DataFrame:
    """H2."""
    return edges.dropDuplicates(list(cols) if cols else None)


def align_union(load: DataFrame, changes: DataFrame | None = None, op_col: str = "Op", op_value: str = "I") -> DataFrame:
    """H3: give initial-load rows the change files' leading operation column (``Op='I'``) and stack."""
    aligned = add_constant(load, op_col, op_value, first=True)
    return aligned if changes is None else aligned.unionByName(changes)
