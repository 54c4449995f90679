"""Hour and day tiers of a meter's rollup (Q2-Q4, Q15).

A tier holds the same mergeable states as the minute rollup, one row per hour or
day and the rollup's other keys. A query over a range is answered from the
coarsest rows that fit: minutes at the edges, then hours, days in between.
States are merged as from minutes, so every aggregation is exact.

A tier row keeps the first start and the last end of the minutes it was merged
from as its window, so a whole-range query reports the same bounds; ``tier_start``
is the hour or day itself. A tier is a table derived from the minute rollup it
was built from; batches that came later are given to ``query_tiers`` as
``later`` minutes until it is built again.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterkit.functions import column
from meterkit.functions.time import window_start
from meterkit.operators.query import _aggregate, _dimension_filters, _merge_value
from meterkit.operators.rollup import merge_states, state_columns
from meterkit.plans.spec import MeterQuery, MeterSpec

#: Coarsest first.
SIZES = {"day": dt.timedelta(days=1), "hour": dt.timedelta(hours=1), "minute": dt.timedelta(minutes=1)}


def build_tier(partials: DataFrame, spec: MeterSpec, size: str) -> DataFrame:
    """Merge minute partials (or a finer tier) to one row per ``size`` and key:
    one partial-aggregated shuffle on the key. An exact unique meter keeps a
    row per distinct value."""
    keys = [F.col("tier_start"), *(column(c) for c in ("organization", "user", *spec.dimensions))]
    span = [F.min("windowstart").alias("windowstart"), F.max("windowend").alias("windowend")]
    df = partials.withColumn("tier_start", window_start(F.col("windowstart"), size))
    if spec.aggregation == "unique_count" and spec.unique_mode == "exact":
        out = df.groupBy(*keys, "uniq_v").agg(*span)
    else:
        out = df.groupBy(*keys).agg(*span, *merge_states(spec))
    return out.withColumn("window_date", F.to_date("tier_start"))


def _floor(t: dt.datetime, size: str) -> dt.datetime:
    midnight = t.replace(hour=0, minute=0, second=0, microsecond=0)
    return midnight + (t - midnight) // SIZES[size] * SIZES[size]


def decompose(start: dt.datetime | None, end: dt.datetime | None,
              sizes: list[str]) -> list[tuple[str, dt.datetime | None, dt.datetime | None]]:
    """Cut ``[start, end)`` into (size, from, to) pieces in time order, each as
    coarse as fits; ``sizes`` from coarse to fine. None is unbounded."""
    size, finer = sizes[0], sizes[1:]
    if not finer:
        return [(size, start, end)]
    lo, hi = start and _floor(start, size), end and _floor(end, size)
    if lo is not None and lo < start:
        lo += SIZES[size]
    if lo is not None and hi is not None and lo >= hi:
        return decompose(start, end, finer)
    left = decompose(start, lo, finer) if lo != start else []
    right = decompose(hi, end, finer) if hi != end else []
    return left + [(size, lo, hi)] + right


def query_tiers(tiers: dict[str, DataFrame], spec: MeterSpec, q: MeterQuery, later: DataFrame | None = None) -> DataFrame:
    """``query_rollup`` from ``tiers`` (``minute``: the rollup; ``hour``, ``day``:
    from ``build_tier``), reading the coarsest rows that fit the range and the
    query's window. ``later``: minute partials that the tiers do not contain.
    Each piece is a date-pruned scan of one tier."""
    q.validate(spec)
    start, end = q.bounds()
    fits = list(SIZES)[list(SIZES).index(q.window_size or "day"):]
    keep = ["windowstart", "windowend", *dict.fromkeys([*q.group_by, *(n for n, v in q.filters.items() if v)]),
            *state_columns(spec)]
    pieces = [(tiers[size], size, lo, hi) for size, lo, hi in decompose(start, end, [s for s in fits if s in tiers])]
    if later is not None:
        pieces.append((later, "minute", start, end))
    parts = []
    for df, size, lo, hi in pieces:
        at = "windowstart" if size == "minute" else "tier_start"
        if lo is not None:
            df = df.where((F.col(at) >= F.lit(lo)) & (F.col("window_date") >= F.lit(lo.date())))
        if hi is not None:  # whole windows: one that starts before ``hi`` ends by then
            df = df.where((F.col(at) <= F.lit(hi - SIZES[size])) & (F.col("window_date") <= F.lit(hi.date())))
        parts.append(df.select(*(column(c) for c in keep)))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return _aggregate(_dimension_filters(every, q), q, _merge_value(spec))
