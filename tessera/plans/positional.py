"""J3 positional_merge: pair rows of two unrelated tables by position, CSV round trip, profile."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.operators.joins import positional_join
from tessera.sinks.files import write_csv
from tessera.sources.files import read_csv


def positional_merge(left: DataFrame, right: DataFrame, left_order, right_order) -> DataFrame:
    """E1 + E2 + C5: n-th row with n-th row, index dropped."""
    return positional_join(left, right, left_order, right_order)


def csv_round_trip(df: DataFrame, path: str, null_marker: str = "NA") -> DataFrame:
    """B4 + A2: write with a null marker, read back (quoted newlines allowed) with the same marker.

    Every column comes back as STRING. Reading back with the marker keeps null and the marker
    apart only if no real value equals the marker.
    """
    write_csv(df, path, null_marker=null_marker)
    return read_csv(df.sparkSession, path, multi_line=True, null_marker=null_marker)
