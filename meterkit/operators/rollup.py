"""Meter rollups: filter -> extract -> 1-minute tumble -> partial aggregate.

A rollup holds *mergeable partial states* per
``(windowstart, windowend, organization, user, <properties sorted>)`` so any
coarser window or dimension subset is a re-aggregation of it (M1-M12):

=============  ====================================================
aggregation    state columns
=============  ====================================================
sum            ``sum_v``
avg            ``sum_v``, ``cnt_v`` (never an average of averages)
min / max      ``min_v`` / ``max_v``
count          ``cnt_v``
unique_count   exact: one row per distinct ``uniq_v`` in the group;
               hll: ``uniq_hll`` (mergeable HLL sketch, bounded size)
=============  ====================================================

Exact distinct values are stored as rows rather than as an array per group:
a hot organization/user pair can hold millions of distinct values in one
minute, and rows keep every record bounded while the shuffle spreads such a
group over tasks by value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterkit.functions import column
from meterkit.functions.json import number, text_map, text_value
from meterkit.functions.time import window_end, window_start
from meterkit.plans.spec import MeterSpec

_PROPS = "__props"
VALUE = "__value"

# State columns kept per aggregation.
STATE_COLUMNS = {
    "sum": ("sum_v",),
    "avg": ("sum_v", "cnt_v"),
    "min": ("min_v",),
    "max": ("max_v",),
    "count": ("cnt_v",),
    "unique_count": ("uniq_v",),
}
HLL_STATE = "uniq_hll"
HLL_LG_CONFIG_K = 12


def state_columns(spec: MeterSpec) -> tuple[str, ...]:
    if spec.aggregation == "unique_count" and spec.unique_mode == "hll":
        return (HLL_STATE,)
    return STATE_COLUMNS[spec.aggregation]


def group_columns(spec: MeterSpec) -> list[Column]:
    """Rollup grain, in the reference's sort-key order."""
    return [column(c) for c in ("windowstart", "windowend", "organization", "user", *spec.dimensions)]


def value_column(spec: MeterSpec, parsed: Column) -> Column | None:
    """The measured value (M3): text for unique_count, double otherwise."""
    if spec.aggregation == "count" and not spec.value_property:
        return None
    text = text_value(parsed, spec.value_property)
    if spec.aggregation == "unique_count":
        return text
    return number(text)


def extract(events: DataFrame, spec: MeterSpec) -> DataFrame:
    """M1-M4: the meter's events with its dimensions, value and minute window.

    Output: organization, user, windowstart, windowend, <dims>, ``__value``
    (absent for count meters). The properties text is parsed once per row.
    """
    typed = events.where(F.col("type") == F.lit(spec.event_type)).select(
        "organization", "user", "timestamp", text_map(F.col("properties")).alias(_PROPS))
    parsed = F.col(_PROPS)
    start = window_start(F.col("timestamp"), "minute")
    cols = [
        F.col("organization"),
        F.col("user"),
        start.alias("windowstart"),
        window_end(start, "minute").alias("windowend"),
    ]
    cols += [text_value(parsed, name).alias(name) for name in spec.dimensions]
    value = value_column(spec, parsed)
    if value is not None:
        cols.append(value.alias(VALUE))
    return typed.select(*cols)


def measured(aggregated: DataFrame, spec: MeterSpec, state: str | None = None) -> DataFrame:
    """Drop groups that saw no numeric value.

    Numeric aggregates skip null (non-numeric) values, so a group that only
    saw such values comes out null; removing it after the aggregation equals
    removing the events before it, without a second JSON parse per row that a
    pre-filter would cost once Catalyst pushes it below the projection.
    """
    if spec.aggregation in ("sum", "min", "max"):
        return aggregated.where(F.col(state or STATE_COLUMNS[spec.aggregation][0]).isNotNull())
    if spec.aggregation == "avg" or spec.numeric_value:
        return aggregated.where(F.col(state or "cnt_v") > 0)
    return aggregated


def rollup_rejects(events: DataFrame, spec: MeterSpec) -> DataFrame:
    """Events of the meter's type whose value is not numeric (reason column).

    The reference's rollup insert fails on such a value; here the event is
    set aside with reason ``non_numeric_value`` and the rest is metered.
    """
    if not spec.numeric_value:
        return events.limit(0).withColumn("reason", F.lit(None).cast("string"))
    parsed = text_map(F.col("properties"))
    value = number(text_value(parsed, spec.value_property))
    return (events.where(F.col("type") == F.lit(spec.event_type))
            .where(value.isNull())
            .withColumn("reason", F.lit("non_numeric_value")))


def partial_states(spec: MeterSpec) -> list[Column]:
    """Partial aggregate expressions over extracted rows."""
    v = F.col(VALUE)
    agg = spec.aggregation
    if agg == "sum":
        return [F.sum(v).alias("sum_v")]
    if agg == "avg":
        return [F.sum(v).alias("sum_v"), F.count(v).alias("cnt_v")]
    if agg == "min":
        return [F.min(v).alias("min_v")]
    if agg == "max":
        return [F.max(v).alias("max_v")]
    if agg == "count":
        return [F.count(v if spec.value_property else F.lit(1)).alias("cnt_v")]
    if spec.unique_mode == "hll":
        return [F.hll_sketch_agg(v, HLL_LG_CONFIG_K).alias(HLL_STATE)]
    raise ValueError("exact unique_count partials are distinct rows, not an aggregate")


def minute_partials(events: DataFrame, spec: MeterSpec) -> DataFrame:
    """Build the minute rollup of one meter from typed events.

    One hash aggregation (partial + final by Spark) on the rollup grain; the
    ``window_date`` column is the storage partition key.
    """
    spec.validate(require_properties=False)
    rows = extract(events, spec)
    keys = group_columns(spec)
    if spec.aggregation == "unique_count" and spec.unique_mode == "exact":
        out = rows.select(*keys, F.col(VALUE).alias("uniq_v")).distinct()
    else:
        out = measured(rows.groupBy(*keys).agg(*partial_states(spec)), spec)
    return out.withColumn("window_date", F.to_date("windowstart"))


def merge_states(spec: MeterSpec) -> list[Column]:
    """State merge that keeps partial form (used by compaction, M12)."""
    agg = spec.aggregation
    if agg == "sum":
        return [F.sum("sum_v").alias("sum_v")]
    if agg == "avg":
        return [F.sum("sum_v").alias("sum_v"), F.sum("cnt_v").alias("cnt_v")]
    if agg == "min":
        return [F.min("min_v").alias("min_v")]
    if agg == "max":
        return [F.max("max_v").alias("max_v")]
    if agg == "count":
        return [F.sum("cnt_v").alias("cnt_v")]
    if spec.unique_mode == "hll":
        return [F.hll_union_agg(HLL_STATE, True).alias(HLL_STATE)]
    raise ValueError("exact unique_count partials merge by distinct")


def compact_partials(partials: DataFrame, spec: MeterSpec) -> DataFrame:
    """Fold rows with equal grain into one (AggregatingMergeTree merge)."""
    keys = group_columns(spec) + [F.col("window_date")]
    if spec.aggregation == "unique_count" and spec.unique_mode == "exact":
        return partials.select(*keys, "uniq_v").distinct()
    return partials.groupBy(*keys).agg(*merge_states(spec))
