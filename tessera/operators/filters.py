"""Filters (D1-D6). Plain predicates so Catalyst can push them into the file scan."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import valid_format


def null_key_rows(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key is null (returned as a DataFrame, never collected)."""
    return df.filter(F.col(key).isNull())


def matching(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose whole value matches ``pattern``."""
    return df.filter(valid_format(column, pattern))


def in_scope(df: DataFrame, column: str, value) -> DataFrame:
    """D3: equality scope (e.g. one network of groups); ``value=None`` keeps everything."""
    return df if value is None else df.filter(F.col(column) == F.lit(value))


def _as_date(value) -> _dt.date:
    if isinstance(value, _dt.datetime):
        return value.date()
    if isinstance(value, _dt.date):
        return value
    return _dt.date.fromisoformat(str(value))


def older_than(df: DataFrame, column: str, days: int, as_of) -> DataFrame:
    """Created day strictly before ``as_of - days`` (exactly ``days`` old is kept out)."""
    cutoff = _as_date(as_of) - _dt.timedelta(days=days)
    return df.filter(F.to_date(F.col(column)) < F.lit(cutoff))


def day_bounds(as_of, days_back: int = 1) -> tuple[_dt.datetime, _dt.datetime]:
    """D5 bounds: ``[start of (as_of - days_back), start of as_of)``, as naive UTC datetimes."""
    end = _as_date(as_of)
    start = end - _dt.timedelta(days=days_back)
    return (_dt.datetime.combine(start, _dt.time()), _dt.datetime.combine(end, _dt.time()))


def time_range(df: DataFrame, column: str, start: _dt.datetime, end: _dt.datetime) -> DataFrame:
    """``start <= ts < end``. Literals typed like the column (NTZ vs LTZ) so the filter pushes down."""
    if df.schema[column].dataType.simpleString() == "timestamp_ntz":
        lo = F.expr(f"timestamp_ntz'{start.isoformat(' ')}'")
        hi = F.expr(f"timestamp_ntz'{end.isoformat(' ')}'")
    else:  # instants: the bounds are UTC day boundaries whatever the session time zone
        lo = F.expr(f"timestamp'{start.isoformat(' ')}Z'")
        hi = F.expr(f"timestamp'{end.isoformat(' ')}Z'")
    return df.filter((F.col(column) >= lo) & (F.col(column) < hi))


def not_in(df: DataFrame, other: DataFrame, on) -> DataFrame:
    """Rows of ``df`` whose key is absent from ``other`` (anti-join; nulls in ``other`` harmless)."""
    return df.join(other, on=on, how="left_anti")
