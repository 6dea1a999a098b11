"""J5 usage_report: daily average per entity and class, pivoted, totalled, ranked, formatted."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions._util import int_div
from tessera.functions.sizes import human_size
from tessera.operators.aggregates import class_totals, pivot_classes, row_total
from tessera.operators.filters import day_bounds, time_range
from tessera.operators.ranking import ranked

# Storage classes of the source metrics and their short report names, in report order.
STORAGE_CLASSES = {"StandardStorage": "ST", "StandardIAStorage": "IA", "ReducedRedundancyStorage": "RR"}
SHORT_CLASSES = ["ST", "IA", "RR"]
REPORT_COLUMNS = ["Row", "Bucket", "StandardSize", "IASize", "RRSize", "Total"]


def daily_sizes(metrics: DataFrame, entity: str, cls: str, ts: str, value: str, as_of,
                class_map: Mapping[str, str] = STORAGE_CLASSES, integer: bool = True) -> DataFrame:
    """D5 + F4 + F5 + C14: one row per entity that has data that day, columns ST/IA/RR.

    The one-day range filter is pushed into the scan; the average is per (entity, class) over
    that single day (``sum div count`` on integer bytes when ``integer``, summed as decimals so that they don't
    overflow; else ``avg``).
    """
    lo, hi = day_bounds(as_of)
    mapping = F.create_map(*[F.lit(x) for kv in class_map.items() for x in kv])
    day = time_range(metrics, ts, lo, hi).filter(F.col(cls).isin(*class_map)).select(
        F.col(entity), mapping[F.col(cls)].alias("__cls"), F.col(value).alias("__v"))
    avg = int_div(F.sum(F.col("__v").cast("decimal(28,0)")), F.count(F.lit(1))).cast("long") if integer else F.avg("__v")
    per = day.groupBy(entity, "__cls").agg(avg.alias("__avg"))
    return pivot_classes(per, entity, "__cls", "__avg", list(dict.fromkeys(class_map.values())), time_col=None)


def usage_table(sizes: DataFrame, entities: DataFrame, entity: str) -> DataFrame:
    """Every listed entity (left join; no data -> zeros) with ``Total = ST + IA + RR``."""
    wide = entities.select(entity).distinct().join(sizes, on=entity, how="left").na.fill(0, subset=SHORT_CLASSES)
    return wide.withColumn("Total", row_total(SHORT_CLASSES))


def usage_report(table: DataFrame, entity: str) -> DataFrame:
    """G1 + G2 + C12: ranked by total (largest first, ties by entity), sizes as text."""
    r = ranked(table, "Total", [entity], name="Row")
    return r.select(
        F.col("Row"), F.col(entity).alias("Bucket"),
        human_size("ST").alias("StandardSize"), human_size("IA").alias("IASize"),
        human_size("RR").alias("RRSize"), human_size("Total").alias("Total"))


def usage_totals(table: DataFrame) -> DataFrame:
    """per-class totals and the grand total, as text."""
    t = class_totals(table, SHORT_CLASSES, "Total")
    return t.select(human_size("ST").alias("StandardTotal"), human_size("IA").alias("IATotal"),
                    human_size("RR").alias("RRTotal"), human_size("Total").alias("GrandTotal"))


# Test-data shape: events as metrics (user = bucket, event type = storage class, value in cents * 10^4 = bytes).
EVENT_CLASSES = {"view": "ST", "click": "IA", "error": "RR"}


def events_bytes(events: DataFrame) -> DataFrame:
    return events.select("user_id", "event_type", "ts",
                         (F.round(F.col("value") * 100).cast("long") * 10000).alias("bytes"))


def events_table(events: DataFrame, as_of="2024-01-03") -> DataFrame:
    sizes = daily_sizes(events_bytes(events), "user_id", "event_type", "ts", "bytes", as_of, EVENT_CLASSES)
    return usage_table(sizes, events, "user_id")
