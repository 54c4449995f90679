"""Meter queries: merge minute partials on read (Q1-Q18).

``query_rollup`` re-aggregates a stored rollup to minute, hour, day or the
whole range; ``query_events`` answers the same query straight from events
(one aggregation, used for checks and for meters without a rollup). Both
return ``windowstart, windowend, value, <group_by...>`` with ``value`` a
double, as the reference does, in no particular order.

Filters and the time range are applied before aggregation and reach the
Parquet scan: dimension predicates as pushed filters, the time range on
``windowstart``/``windowend`` plus a derived ``window_date`` range that
prunes whole partitions.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterkit.functions import column
from meterkit.functions.time import window_end, window_start
from meterkit.operators.rollup import HLL_STATE, VALUE, extract
from meterkit.plans.spec import MeterQuery, MeterSpec


def _dimension_filters(df: DataFrame, q: MeterQuery) -> DataFrame:
    """Q12-Q14: one value is equality, several are IN, none is skipped."""
    for name, values in q.filters.items():
        if not values:
            continue
        if len(values) == 1:
            df = df.where(column(name) == F.lit(values[0]))
        else:
            df = df.where(column(name).isin(*values))
    return df


def _last_date_before(end: dt.datetime) -> dt.date:
    return (end - dt.timedelta(microseconds=1)).date()


def _time_range(df: DataFrame, q: MeterQuery, partitioned: bool) -> DataFrame:
    """Q15: ``windowstart >= from AND windowend <= to`` on adjusted bounds."""
    start, end = q.bounds()
    if start is not None:
        df = df.where(F.col("windowstart") >= F.lit(start))
        if partitioned:
            df = df.where(F.col("window_date") >= F.lit(start.date()))
    if end is not None:
        df = df.where(F.col("windowend") <= F.lit(end))
        if partitioned:
            df = df.where(F.col("window_date") <= F.lit(_last_date_before(end)))
    return df


def _window_keys(q: MeterQuery) -> list[Column]:
    """Q1-Q3: stored minute grain, or re-tumbled to the hour or the day.

    The window end is derived from the window start, so every group is one
    whole window (the reference's end-of-hour quirk F6 is not reproduced).
    """
    size = q.window_size
    if size == "minute":
        return [F.col("windowstart"), F.col("windowend")]
    start = window_start(F.col("windowstart"), size)
    return [start.alias("windowstart"), window_end(start, size).alias("windowend")]


def _merge_value(spec: MeterSpec) -> Column:
    """Q5-Q10: merge partial states into the final value (double)."""
    agg = spec.aggregation
    if agg == "sum":
        value = F.sum("sum_v")
    elif agg == "avg":
        value = F.sum("sum_v") / F.sum("cnt_v")
    elif agg == "min":
        value = F.min("min_v")
    elif agg == "max":
        value = F.max("max_v")
    elif agg == "count":
        value = F.coalesce(F.sum("cnt_v"), F.lit(0))  # countMerge of nothing is 0
    elif spec.unique_mode == "hll":
        value = F.hll_sketch_estimate(F.hll_union_agg(HLL_STATE, True))
    else:
        value = F.count_distinct(F.col("uniq_v"))
    return value.cast("double").alias("value")


def _direct_value(spec: MeterSpec) -> Column:
    """Final aggregate straight over extracted events."""
    agg = spec.aggregation
    v = F.col(VALUE)
    if agg == "sum":
        value = F.sum(v)
    elif agg == "avg":
        value = F.avg(v)
    elif agg == "min":
        value = F.min(v)
    elif agg == "max":
        value = F.max(v)
    elif agg == "count":
        value = F.count(v if spec.value_property else F.lit(1))
    elif spec.unique_mode == "hll":
        value = F.hll_sketch_estimate(F.hll_sketch_agg(v))
    else:
        value = F.count_distinct(v)
    return value.cast("double").alias("value")


def _aggregate(df: DataFrame, q: MeterQuery, value: Column, counted: Column | None = None) -> DataFrame:
    """Group to the output window and dimensions.

    ``counted`` marks the rows that carry a value; the whole-range bounds are
    taken over those rows only.
    """
    dims = [column(d) for d in q.group_by]
    if q.window_size is not None:
        keys = _window_keys(q)
        out = df.groupBy(*keys, *dims).agg(value)
        return out.select("windowstart", "windowend", "value", *[column(d) for d in q.group_by])
    # Q4: whole range -> earliest start and latest end of the matched minutes.
    start, end = F.col("windowstart"), F.col("windowend")
    if counted is not None:
        start, end = F.when(counted, start), F.when(counted, end)
    out = df.groupBy(*dims).agg(
        F.min(start).alias("windowstart"),
        F.max(end).alias("windowend"),
        value,
    )
    return out.select("windowstart", "windowend", "value", *[column(d) for d in q.group_by])


def query_rollup(partials: DataFrame, spec: MeterSpec, q: MeterQuery,
                 partitioned: bool = True) -> DataFrame:
    """Answer a meter query from its minute rollup (merge on read)."""
    q.validate(spec)
    df = _dimension_filters(partials, q)
    df = _time_range(df, q, partitioned and "window_date" in partials.columns)
    return _aggregate(df, q, _merge_value(spec))


def query_events(events: DataFrame, spec: MeterSpec, q: MeterQuery) -> DataFrame:
    """Answer a meter query directly from typed events (no rollup).

    Besides the window predicates an implied range on the raw ``timestamp``
    is added so Parquet statistics can skip row groups, and on
    ``event_date`` when the events table is partitioned by it.
    """
    q.validate(spec)
    start, end = q.bounds()
    dated = "event_date" in events.columns
    if start is not None:
        floor = start.replace(second=0, microsecond=0)
        events = events.where(F.col("timestamp") >= F.lit(floor))
        if dated:
            events = events.where(F.col("event_date") >= F.lit(floor.date()))
    if end is not None:
        events = events.where(F.col("timestamp") < F.lit(end))
        if dated:
            events = events.where(F.col("event_date") <= F.lit(_last_date_before(end)))
    df = _dimension_filters(extract(events, spec), q)
    df = _time_range(df, q, partitioned=False)
    if not spec.numeric_value:
        return _aggregate(df, q, _direct_value(spec))
    out = _aggregate(df, q, _direct_value(spec), F.col(VALUE).isNotNull())
    if q.window_size is None and not q.group_by:
        return out  # a global aggregate keeps its single row, as the rollup path does
    # groups that saw only non-numeric values have no rollup row either
    return out.where(F.col("value") > 0) if spec.aggregation == "count" else out.where(F.col("value").isNotNull())


def result_range(result: DataFrame, q: MeterQuery) -> DataFrame:
    """Q17: earliest start / latest end of the rows, clamped to the request.

    No rows gives the request's own from/to. One-row DataFrame with
    ``window_start``, ``window_end``.
    """
    start = F.min("windowstart")
    end = F.max("windowend")
    from_ts = _naive(q.from_ts)
    to_ts = _naive(q.to_ts)
    if from_ts is not None:
        start = F.when(start.isNull(), F.lit(from_ts)).otherwise(F.greatest(start, F.lit(from_ts)))
    if to_ts is not None:
        end = F.when(end.isNull(), F.lit(to_ts)).otherwise(F.least(end, F.lit(to_ts)))
    return result.agg(start.alias("window_start"), end.alias("window_end"))


def _naive(ts: dt.datetime | None) -> dt.datetime | None:
    if ts is not None and ts.tzinfo is not None:
        ts = ts.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return ts


def shape_rows(result: DataFrame, q: MeterQuery) -> DataFrame:
    """Q18: dimensions packed into ``group_by map<string,string>``.

    Null dimensions are left out of the map, as the reference's row scanner
    does; ``value`` stays a double.
    """
    dims = list(q.group_by)
    if dims:
        packed = F.map_filter(
            F.map_from_arrays(F.array(*[F.lit(d) for d in dims]),
                              F.array(*[column(d).cast("string") for d in dims])),
            lambda k, v: v.isNotNull())
    else:
        packed = F.create_map().cast("map<string,string>")
    return result.select("windowstart", "windowend", "value", packed.alias("group_by"))
