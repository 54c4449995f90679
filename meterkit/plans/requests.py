"""Request bodies in the reference's API shape -> MeterSpec / MeterQuery.

``POST /v1/meters`` bodies become a ``MeterSpec`` (API rules: name, slug,
event_type, at least one property, aggregation in the allowed set; a count
meter's value property is blanked, every other aggregation needs one).
``POST /v1/meters/query`` bodies become ``(meter_slug, MeterQuery)`` with
RFC 3339 ``from``/``to``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from typing import Any

from meterkit.operators.catalog import DEFAULT_LIMIT, DEFAULT_PAGE, Page
from meterkit.plans.spec import AGGREGATIONS, WINDOW_SIZES, MeterQuery, MeterQueryError, MeterSpec, MeterSpecError


def _required(body: Mapping[str, Any], *names: str, error=MeterSpecError) -> None:
    missing = [n for n in names if body.get(n) in (None, "", [])]
    if missing:
        raise error(f"missing required field(s): {', '.join(missing)}")


def meter_spec_from_request(body: Mapping[str, Any], tenant_slug: str) -> MeterSpec:
    _required(body, "name", "slug", "event_type", "properties", "aggregation")
    aggregation = body["aggregation"]
    if aggregation not in AGGREGATIONS:
        raise MeterSpecError(f"unknown aggregation {aggregation!r}")
    value_property = body.get("value_property") or None
    if aggregation == "count":
        value_property = None
    elif not value_property:
        raise MeterSpecError("value_property is required")
    spec = MeterSpec(slug=body["slug"], event_type=body["event_type"], aggregation=aggregation,
                     value_property=value_property, properties=tuple(body["properties"]),
                     tenant_slug=tenant_slug, populate=bool(body.get("populate", True)))
    return spec.validate()


def parse_rfc3339(text: str | None) -> dt.datetime | None:
    if text is None:
        return None
    try:
        value = dt.datetime.fromisoformat(text.replace("z", "Z"))
    except ValueError as exc:
        raise MeterQueryError(f"invalid timestamp {text!r}") from exc
    if value.tzinfo is None:
        raise MeterQueryError(f"timestamp {text!r} needs a zone offset (RFC 3339)")
    return value


def meter_query_from_request(body: Mapping[str, Any]) -> tuple[str, MeterQuery]:
    _required(body, "meter_slug", error=MeterQueryError)
    window = body.get("window_size")
    if window is not None and window not in WINDOW_SIZES:
        raise MeterQueryError("window_size must be one of minute, hour, day")
    query = MeterQuery(
        window_size=window,
        from_ts=parse_rfc3339(body.get("from")),
        to_ts=parse_rfc3339(body.get("to")),
        group_by=tuple(body.get("group_by") or ()),
        filters=dict(body.get("filter_group_by") or {}),
        window_time_zone=body.get("window_time_zone"),
    )
    return body["meter_slug"], query


# Fixed value: the API's largest page.
MAX_LIMIT = 100


def page_from_request(page: int | None = None, limit: int | None = None) -> Page:
    """The API's paging rule: a page below 1 is the first; a limit outside
    1 to 100 is the default. Operators take any page."""
    return Page(page if isinstance(page, int) and page >= 1 else DEFAULT_PAGE,
                limit if isinstance(limit, int) and 1 <= limit <= MAX_LIMIT else DEFAULT_LIMIT)
