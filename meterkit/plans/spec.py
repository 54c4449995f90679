"""Meter definitions and meter queries, validated before any plan is built.

A ``MeterSpec`` says which events a meter counts and how (M15); a
``MeterQuery`` says how to read it back (Q11-Q16). Time-range rounding (Q15)
happens here, on the driver, on two scalars, before Spark plans anything.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

# The aggregations, window sizes and time zone the reference accepts.
AGGREGATIONS = ("sum", "avg", "min", "max", "count", "unique_count")
WINDOW_SIZES = ("minute", "hour", "day")
SUPPORTED_TIME_ZONE = "UTC"

# Columns every rollup carries; a property may not shadow them.
FIXED_DIMENSIONS = ("organization", "user")
RESERVED_COLUMNS = FIXED_DIMENSIONS + ("windowstart", "windowend", "window_date", "batch_id", "value",
                                       "sum_v", "cnt_v", "min_v", "max_v", "uniq_v", "uniq_hll")

WINDOW_LENGTH = {
    "minute": dt.timedelta(minutes=1),
    "hour": dt.timedelta(hours=1),
    "day": dt.timedelta(days=1),
}


class MeterSpecError(ValueError):
    """A meter definition the reference would refuse."""


class MeterQueryError(ValueError):
    """A meter query the reference would refuse."""


@dataclass(frozen=True)
class MeterSpec:
    slug: str
    event_type: str
    aggregation: str
    value_property: str | None = None
    properties: tuple[str, ...] = ()
    tenant_slug: str = "default"
    populate: bool = True
    # "exact" keeps distinct values per minute; "hll" keeps a mergeable sketch.
    unique_mode: str = "exact"
    # The API blanks a count meter's value property (F18); the rollup layer can
    # also count the numeric values of a property (M10) when this is set.
    count_values: bool = False

    def __post_init__(self):
        object.__setattr__(self, "properties", tuple(self.properties))
        if self.aggregation == "count" and not self.count_values:
            object.__setattr__(self, "value_property", None)

    @property
    def numeric_value(self) -> bool:
        """The value is read as a number (F10): sum/avg/min/max, counted values."""
        return self.aggregation in ("sum", "avg", "min", "max") or (
            self.aggregation == "count" and bool(self.value_property))

    @property
    def dimensions(self) -> tuple[str, ...]:
        """Property columns of the rollup, sorted by name like the reference."""
        return tuple(sorted(set(self.properties)))

    @property
    def required_properties(self) -> tuple[str, ...]:
        names = set(p for p in self.properties if p)
        if self.value_property:
            names.add(self.value_property)
        return tuple(sorted(names))

    def validate(self, require_properties: bool = True) -> "MeterSpec":
        if self.aggregation not in AGGREGATIONS:
            raise MeterSpecError(f"unknown aggregation {self.aggregation!r}")
        if not self.slug or not self.event_type:
            raise MeterSpecError("slug and event_type are required")
        if (self.aggregation != "count" or self.count_values) and not self.value_property:
            raise MeterSpecError(f"value_property is required for {self.aggregation} meters")
        if require_properties and not self.properties:
            raise MeterSpecError("at least one property is required")
        for name in self.properties:
            if not name:
                raise MeterSpecError("property names must be non-empty")
            if name in RESERVED_COLUMNS:
                raise MeterSpecError(f"property name {name!r} collides with a rollup column")
        if self.unique_mode not in ("exact", "hll"):
            raise MeterSpecError(f"unknown unique_mode {self.unique_mode!r}")
        return self


def _as_utc_naive(ts: dt.datetime) -> dt.datetime:
    """Normalise to naive UTC (the session time zone) before rounding."""
    if ts.tzinfo is not None:
        ts = ts.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return ts


def _floor(ts: dt.datetime, size: str) -> dt.datetime:
    if size == "minute":
        return ts.replace(second=0, microsecond=0)
    if size == "hour":
        return ts.replace(minute=0, second=0, microsecond=0)
    return ts.replace(hour=0, minute=0, second=0, microsecond=0)


@dataclass(frozen=True)
class MeterQuery:
    window_size: str | None = None
    from_ts: dt.datetime | None = None
    to_ts: dt.datetime | None = None
    group_by: tuple[str, ...] = ()
    filters: Mapping[str, Sequence[str]] = field(default_factory=dict)
    window_time_zone: str | None = None

    def __post_init__(self):
        # a repeated name is one dimension (the result's group_by map has one key per name)
        object.__setattr__(self, "group_by", tuple(dict.fromkeys(self.group_by)))
        object.__setattr__(self, "filters", {k: tuple(v) for k, v in dict(self.filters).items()})

    def validate(self, spec: MeterSpec) -> "MeterQuery":
        if self.window_time_zone is not None and self.window_time_zone != SUPPORTED_TIME_ZONE:
            raise MeterQueryError("window_time_zone must be UTC")
        if self.window_size is not None and self.window_size not in WINDOW_SIZES:
            raise MeterQueryError("window_size must be one of minute, hour, day")
        if self.window_size is not None and (self.from_ts is None or self.to_ts is None):
            raise MeterQueryError("a window_size needs from and to")
        if spec.aggregation not in AGGREGATIONS:
            raise MeterQueryError(f"meter {spec.slug} has the unknown aggregation {spec.aggregation!r}")
        known = set(FIXED_DIMENSIONS) | set(spec.dimensions)
        # An empty filter list is skipped before its column is looked at (Q14).
        for name in list(self.group_by) + [k for k, v in self.filters.items() if v]:
            if name not in known:
                raise MeterQueryError(f"unknown dimension {name!r} for meter {spec.slug}")
        return self

    def bounds(self) -> tuple[dt.datetime | None, dt.datetime | None]:
        """Adjusted [from, to] on whole windows.

        Minute: both ends truncated down. Hour/day: start truncated down, end
        rounded up unless already aligned. No window: the bounds as given.
        """
        start = _as_utc_naive(self.from_ts) if self.from_ts else None
        end = _as_utc_naive(self.to_ts) if self.to_ts else None
        size = self.window_size
        if size is None:
            return start, end
        start = _floor(start, size)
        floored_end = _floor(end, size)
        if size == "minute" or floored_end == end:
            end = floored_end
        else:
            end = floored_end + WINDOW_LENGTH[size]
        return start, end
