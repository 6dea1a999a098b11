"""G3 on streams: daily averages per entity and class with a watermark for late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_average_stream(stream: DataFrame, entity: str, cls: str, ts: str, value: str,
                         late: str, name: str = "average") -> DataFrame:
    """Tumbling one-day windows over a stream. Rows later than ``late`` behind the newest event
    are dropped, and a window is emitted (append mode) once the watermark has passed its end,
    so the state kept is bounded by the lateness, not by the stream's length."""
    ntz = stream.schema[ts].dataType.simpleString() == "timestamp_ntz"
    if ntz:  # event time must be TIMESTAMP; with the session in UTC the wall clock is unchanged
        stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    kind = "timestamp_ntz" if ntz else "timestamp"
    return (stream.withWatermark(ts, late)
            .groupBy(F.col(entity), F.col(cls), F.window(F.col(ts), "1 day").alias("w"))
            .agg(F.avg(F.col(value)).alias(name), F.count(F.lit(1)).alias("n"))
            .select(entity, cls, F.col("w.start").cast(kind).alias("window_start"),
                    F.col("w.end").cast(kind).alias("window_end"), name, "n"))
