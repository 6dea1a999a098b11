"""J7 stale_items: items older than N days that nothing active refers to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.filters import older_than
from tessera.operators.joins import unreferenced


def stale_items(items: DataFrame, active: DataFrame, name: str = "name", created: str = "created",
                days: int = 100, as_of=None, active_name: str | None = None) -> DataFrame:
    """D4 then E3: ``created`` strictly before ``as_of - days`` and not referenced by ``active``.

    ``as_of`` is a parameter (never the clock). The anti-join needs no distinct on ``active``.
    """
    if as_of is None:
        raise ValueError("stale_items needs an explicit as_of date")
    return unreferenced(older_than(items, created, days, as_of), active, name, active_name)


def orders_input(orders: DataFrame) -> DataFrame:
    return orders.select(F.col("o_orderkey").alias("name"), F.to_date("o_orderdate").alias("created"))


def open_line_orders(lineitem: DataFrame) -> DataFrame:
    return lineitem.filter(F.col("l_linestatus") == "O").select(F.col("l_orderkey").alias("name"))
