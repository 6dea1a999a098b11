"""Replace rows by key, insert the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _hinted(df: DataFrame, hint: str | None) -> DataFrame:
    return df.hint(hint) if hint else df


def latest_per_key(incoming: DataFrame, keys: Sequence[str], order_by: Sequence[str], unique: bool = False, hint: str | None = None) -> DataFrame:
    """The last row per key in ``order_by`` order.

    ``max(struct(order..., row...))`` has a map-side partial step (Spark sorts for it, as the struct is no
    fixed-width value), so a key that holds a third of the batch collapses to one row per task before the shuffle; a
    ``row_number`` window would sort the whole hot key in one task. Ties in the order are
    broken by the row's own values, so the pick is repeatable.

    ``unique``: the rows have different numbers (not null) in the one order column. Then no task sorts whole rows: the last
    numbers are a partial ``max`` over narrow rows, and whole rows meet them by that number, which spreads evenly however
    many rows a key has. ``hint`` is a join hint for the narrow side (``shuffle_hash`` for a large batch).
    """
    keys = list(keys)
    order = list(order_by)
    payload = [c for c in incoming.columns if c not in keys]
    if unique:
        place, = order
        last = incoming.groupBy(*keys).agg(F.max(place).alias(place)).select(place)
        return incoming.join(_hinted(last, hint), place, "left_semi").select(*[F.col(f"`{c}`") for c in [*keys, *payload]])
    packed = F.struct(*[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)],
                      F.struct(*[F.col(f"`{c}`") for c in payload]).alias("row"))
    best = incoming.groupBy(*keys).agg(F.max(packed).alias("__best"))
    return best.select(*keys, *[F.col("__best.row").getField(c).alias(c) for c in payload])


def upsert(base: DataFrame, incoming: DataFrame, keys: Sequence[str], order_by: Sequence[str] | None = None,
           unique: bool = False, hint: str | None = None) -> DataFrame:
    """Whole-row replace by key: rows of ``base`` whose key is in the batch are replaced by the
    batch's last row for that key; new keys are inserted. Columns are those of ``base``.

    ``order_by`` (e.g. file path + row index) decides which duplicate in the batch wins; the
    order columns may be extra columns of ``incoming`` and are dropped afterwards. ``unique`` and ``hint`` are those of
    :func:`latest_per_key`; with ``unique`` the hint holds for the batch's keys against the base too.
    """
    keys = list(keys)
    cols = base.columns
    extra = [c for c in (order_by or []) if c not in cols]
    batch = incoming.select(*[F.col(f"`{c}`") for c in cols], *[F.col(f"`{c}`") for c in extra])
    held = None
    if order_by:
        held = _hinted(batch.select(*keys).distinct(), hint) if unique else None
        batch = latest_per_key(batch, keys, order_by, unique, hint).select(*[F.col(f"`{c}`") for c in cols])
    else:
        batch = batch.dropDuplicates(keys)
    kept = base.join(batch.select(*keys) if held is None else held, on=keys, how="left_anti")
    return kept.unionByName(batch.select(*[F.col(f"`{c}`") for c in cols]))
