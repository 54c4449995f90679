"""Tumbling-window helpers on timestamps (UTC session)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Interval text per window size.
INTERVALS = {"minute": "INTERVAL 1 MINUTE", "hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY"}


def window_start(ts: Column, size: str) -> Column:
    """tumbleStart for a 1-unit window: truncation in the UTC session."""
    return F.date_trunc(size, ts)


def window_end(start: Column, size: str) -> Column:
    return start + F.expr(INTERVALS[size])


def second_precision(ts: Column) -> Column:
    """Event timestamps are kept to whole seconds."""
    return F.date_trunc("second", ts)
