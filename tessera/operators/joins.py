"""Joins (E1-E6): row index, positional join, anti-join, keyed lookups, rule references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.sets import ids_at
from tessera.session import ensure_checkpoint_dir

_MID = "__tessera_mid"
_PID = "__tessera_pid"
_OFF = "__tessera_off"
_LEN = "__tessera_len"
_LOCAL_BITS = 33  # monotonically_increasing_id = partition index << 33 | position in partition


def _cols(order_by) -> list:
    if order_by is None:
        return []
    if isinstance(order_by, (str, Column)):
        return [order_by]
    return list(order_by)


def _sorted(df: DataFrame, order: list) -> DataFrame:
    if not order:
        return df
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.typeName() != "variant"]
    return df.orderBy(*order, F.xxhash64(*hashed))


def add_row_index(df: DataFrame, name: str = "idx", order_by=None, checkpoint: bool | None = None) -> DataFrame:
    """Consecutive 0-based, non-null BIGINT index, computed without a single-partition row path.

    * ``order_by`` given: rows are range-partitioned and sorted (``orderBy``; rows with equal keys by a digest of
      all their columns, so that one key's rows can be many ranges and repeat their places), then the sorted
      result is checkpointed into ``spark.checkpoint.dir`` so that both uses below (per-partition
      counts and row numbering) read the very same partitions, also after an executor loss.
    * ``order_by`` omitted: the index follows the input's partition order. Pass
      ``checkpoint=False`` only when the input is a plain file scan (its partitions are stable);
      anything with a shuffle gets checkpointed (the default).

    Index = position inside the partition + number of rows in all earlier partitions. The
    offsets come from one row per partition (bounded by the partition count, so broadcasting
    them is safe), and only that tiny table passes through a single-partition window.
    """
    order = _cols(order_by)
    base = _sorted(df, order)
    if checkpoint is None:
        checkpoint = True
    if checkpoint:
        ensure_checkpoint_dir(df.sparkSession)
        base = base.checkpoint(eager=True)
    return _numbered(base, name)


def _offsets(tagged: DataFrame) -> DataFrame:
    """Rows before each partition and in it: one row per partition."""
    counts = tagged.groupBy(F.shiftright(F.col(_MID), _LOCAL_BITS).alias(_PID)).agg(F.count(F.lit(1)).alias(_LEN))
    before = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(_PID, _LEN, F.coalesce(F.sum(_LEN).over(before), F.lit(0)).alias(_OFF))


def _numbered(base: DataFrame, name: str, other: DataFrame | None = None) -> DataFrame:
    """The index over a base whose partitions are settled; with ``other`` only the rows that it has a partner for."""
    tagged = base.withColumn(_MID, F.monotonically_increasing_id())
    offsets = _offsets(tagged).drop(_LEN)
    if other is not None:
        # the shorter side's length, one number, meets the offsets: longer rows end here, before any exchange
        length = _offsets(other.withColumn(_MID, F.monotonically_increasing_id())).agg(F.coalesce(F.sum(_LEN), F.lit(0)).alias(_LEN))
        offsets = offsets.crossJoin(F.broadcast(length))
    pid = F.shiftright(F.col(_MID), _LOCAL_BITS)
    local = F.col(_MID).bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    # one row per input partition: a size bound that does not grow with the rows
    joined = tagged.join(F.broadcast(offsets), pid == F.col(_PID), "inner")
    idx = (local + F.col(_OFF)).cast("long")
    if other is not None:
        joined = joined.filter(idx < F.col(_LEN))
    cols = [F.col(f"`{c}`") for c in base.columns]
    # the index is never null
    return joined.select(*cols, idx.alias(name)).select(*cols, F.coalesce(F.col(name), F.lit(0).cast("long")).alias(name))


def positional_join(left: DataFrame, right: DataFrame, left_order=None, right_order=None,
                    name: str = "idx", checkpoint: bool = True) -> DataFrame:
    """N-th row of ``left`` with n-th row of ``right``; the longer side is cut to the shorter before it is shuffled.

    Left columns come first. Give ``left_order``/``right_order`` for a repeatable pairing. Each side is checkpointed
    once, as for :func:`add_row_index`.
    """
    sides = []
    for df, order in ((left, left_order), (right, right_order)):
        base = _sorted(df, _cols(order))
        if checkpoint:
            ensure_checkpoint_dir(df.sparkSession)
            base = base.checkpoint(eager=True)
        sides.append(base)
    li, ri = _numbered(sides[0], name, sides[1]), _numbered(sides[1], name, sides[0])
    return li.join(ri, on=name, how="inner").drop(name)


def unreferenced(all_items: DataFrame, active: DataFrame, key, active_key: str | None = None) -> DataFrame:
    """Items whose key does not occur in ``active`` (anti-join; nulls in ``active`` are harmless).

    The active keys are made distinct first: a partial aggregate that collapses a key referenced by
    a third of all rows before the shuffle (the build side of an anti-join cannot be split by skew
    handling), and whose partitioning the join then reuses.
    """
    if active_key and active_key != key:
        active = active.select(F.col(active_key).alias(key))
    else:
        active = active.select(key)
    return all_items.join(active.distinct(), on=key, how="left_anti")


def restrict_to(ids: DataFrame, facts: DataFrame, key: str, empty: dict | None = None) -> DataFrame:
    """One row per requested key with its facts; keys without facts are kept (left join).

    ``empty`` maps fact columns to a default expression for keys that have no facts.
    """
    out = ids.join(facts, on=key, how="left")
    for c, default in (empty or {}).items():
        out = out.withColumn(c, F.coalesce(F.col(c), default))
    return out


def referencing_groups(groups: DataFrame, rules: DataFrame, group_col: str = "GroupId",
                       owner_col: str = "GroupId", ref_col: str = "ReferencedGroupId",
                       direction_col: str | None = "Direction",
                       directions: Sequence[str] = ("ingress", "egress")) -> DataFrame:
    """E5: for each group, the distinct groups whose rules (ingress or egress) name it.

    ``rules`` has one row per (owner group, direction, referenced group). One equi-join instead
    of one lookup per group; self-references are kept. Output: ``(group_col, "ReferencingGroupId")``.
    """
    r = rules
    if direction_col and direction_col in rules.columns:
        r = r.filter(F.col(direction_col).isin(list(directions)))
    refs = r.select(F.col(ref_col).alias(group_col), F.col(owner_col).alias("ReferencingGroupId")).distinct()
    return groups.select(group_col).distinct().join(refs, on=group_col, how="inner")


def rules_from_nested(groups: DataFrame, id_col: str = "GroupId",
                      ingress_col: str = "IpPermissions", egress_col: str = "IpPermissionsEgress",
                      pairs_field: str = "UserIdGroupPairs", pair_id_field: str = "GroupId") -> DataFrame:
    """Flatten nested rule lists (array<struct<pairs: array<struct<GroupId>>>>) into rule rows, both directions in one scan."""
    named = []
    for col, direction in ((ingress_col, "ingress"), (egress_col, "egress")):
        ids = ids_at(groups.schema, f"{col}[].{pairs_field}[].{pair_id_field}")
        named.append(F.transform(ids, lambda x: F.struct(F.lit(direction).alias("d"), x.alias("r"))))  # noqa: B023
    rows = groups.select(F.col(id_col).alias("GroupId"), F.explode(F.concat(*named)).alias("x"))
    return rows.select("GroupId", F.col("x.d").alias("Direction"), F.col("x.r").alias("ReferencedGroupId")).filter("ReferencedGroupId is not null")


def attach_metadata(df: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """Left join of per-key metadata (name, scope); the planner broadcasts it when its size allows."""
    return df.join(meta, on=key, how="left")
