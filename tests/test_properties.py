"""Property tests: merge law under arbitrary batch splits and orders."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meterkit.operators.query import query_events, query_rollup
from meterkit.operators.rollup import compact_partials, minute_partials
from meterkit.plans.spec import MeterQuery, MeterSpec
from meterkit.sources.fixtures import usage_events

from conftest import SF_SMALL

AGGS = {
    "sum": MeterSpec("s", "app.purchase", "sum", "amount", ("page",)),
    "avg": MeterSpec("a", "app.view", "avg", "amount", ("page",)),
    "max": MeterSpec("x", "app.error", "max", "amount", ("page",)),
    "count": MeterSpec("c", "app.click", "count", None, ("page",)),
    "unique_count": MeterSpec("u", "app.click", "unique_count", "k", ("page",)),
}


def rows(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(agg=st.sampled_from(sorted(AGGS)), parts=st.integers(1, 5), seed=st.integers(0, 1000),
       window=st.sampled_from(["hour", "day", None]), compact=st.booleans())
def test_any_split_merges_to_the_direct_answer(spark, agg, parts, seed, window, compact):
    spec = AGGS[agg]
    events = usage_events(spark, SF_SMALL)
    bucket = F.abs(F.hash(F.col("id"), F.lit(seed))) % parts
    batches = [minute_partials(events.where(bucket == i), spec) for i in range(parts)]
    order = sorted(range(parts), key=lambda i: (i * 7919 + seed) % parts)
    merged = batches[order[0]]
    for i in order[1:]:
        merged = merged.unionByName(batches[i])
    if compact:
        merged = compact_partials(merged, spec)
    q = MeterQuery(window, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 31), group_by=("organization",))
    assert rows(query_rollup(merged, spec, q)) == rows(query_events(events, spec, q))
