"""Calendar features of Unix-second timestamps.

Conventions: UTC; day of week Monday = 0 (``weekday``); weekend = dow >= 5;
rush hour = hours 7-9 or 17-19 inclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import col_of

__all__ = ["event_time", "is_rush_hour", "add_time_features", "add_calendar_names",
           "rush_period", "RUSH_HOURS"]

# Rush-hour windows, inclusive hour ranges.
RUSH_HOURS = ((7, 9), (17, 19))


def event_time(seconds: str | Column = "timestamp") -> Column:
    """Unix seconds -> TIMESTAMP (UTC session zone)."""
    return F.timestamp_seconds(col_of(seconds))


def is_rush_hour(hour: str | Column) -> Column:
    h = col_of(hour)
    cond = None
    for lo, hi in RUSH_HOURS:
        c = h.between(lo, hi)
        cond = c if cond is None else (cond | c)
    return cond


def add_time_features(df: DataFrame, seconds: str = "timestamp") -> DataFrame:
    """B1: hour, day_of_week (Mon=0), month, is_weekend, is_rush_hour."""
    t = event_time(seconds)
    return (df.withColumns({"hour": F.hour(t), "day_of_week": F.weekday(t), "month": F.month(t)})
              .withColumns({"is_weekend": (F.col("day_of_week") >= 5).cast("int"),
                            "is_rush_hour": is_rush_hour("hour").cast("int")}))


def add_calendar_names(df: DataFrame, seconds: str = "timestamp") -> DataFrame:
    """B2: English day and month names and the calendar date."""
    t = event_time(seconds)
    return df.withColumns({"day_name": F.date_format(t, "EEEE"),
                           "month_name": F.date_format(t, "MMMM"),
                           "date": F.to_date(t)})


def rush_period(hour: str | Column) -> Column:
    """Morning Rush (7-9) / Evening Rush (17-19) / Off-Peak."""
    h = col_of(hour)
    (m_lo, m_hi), (e_lo, e_hi) = RUSH_HOURS
    return (F.when(h.between(m_lo, m_hi), "Morning Rush")
             .when(h.between(e_lo, e_hi), "Evening Rush")
             .otherwise("Off-Peak"))
