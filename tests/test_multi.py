"""One pass for many meters equals one pass per meter (M1-M11 over a registry)."""

import datetime as dt

from meterkit.operators.multi import SLOTS, fan_out, long_partials, meter_partials, sub_aggregates
from meterkit.operators.query import query_rollup
from meterkit.operators.rollup import minute_partials
from meterkit.plans.spec import MeterQuery, MeterSpec
from meterkit.sources import rollup_store as store
from meterkit.sources.fixtures import usage_events

from conftest import SF_SMALL

SPECS = [
    MeterSpec("c", "app.click", "count", None, ("page",)),
    MeterSpec("cv", "app.click", "count", "amount", ("k", "page"), count_values=True),
    MeterSpec("s", "app.purchase", "sum", "amount", ("page",)),
    MeterSpec("a", "app.purchase", "avg", "amount", ("page", "k")),
    MeterSpec("mi", "app.signup", "min", "amount", ()),
    MeterSpec("ma", "app.error", "max", "amount", ("page",), tenant_slug="other"),
    MeterSpec("u", "app.click", "unique_count", "k", ("page",)),
    MeterSpec("h", "app.click", "unique_count", "k", ("page",), unique_mode="hll"),
]


def rows(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def test_long_partials_match_per_meter(spark):
    events = usage_events(spark, SF_SMALL)
    long = long_partials(events, SPECS).cache()
    for spec in SPECS[:-1]:  # sketches are no values to compare; see below
        one = minute_partials(events, spec)
        many = meter_partials(long, spec)
        assert many.columns == one.columns
        assert rows(many) == rows(one), spec.slug


def test_write_many_and_backfill_many(spark, scratch_dir):
    events = usage_events(spark, SF_SMALL)
    store.backfill_many(spark, events, scratch_dir, SPECS, scratch_dir + "/long")
    q = MeterQuery("day", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 31), group_by=("organization",))
    for spec in SPECS:
        got = rows(query_rollup(store.read_rollup(spark, scratch_dir, spec), spec, q))
        exp = rows(query_rollup(minute_partials(events, spec), spec, q))
        assert got == exp and got, spec.slug


def test_rows_after_the_join_do_not_grow_with_meters(spark):
    """Meters of one type and dimensions share a sub-aggregate, across tenants."""
    events = usage_events(spark, SF_SMALL)
    few = [MeterSpec("s0", "app.purchase", "sum", "amount", ("page",))]
    many = few + [MeterSpec(f"{agg}{i}", "app.purchase", agg, "amount", ("page",), tenant_slug=f"t{i}")
                  for agg in ("sum", "avg", "min", "max") for i in range(5)]
    many.append(MeterSpec("n", "app.purchase", "count", None, ("page",)))
    assert fan_out(events, sub_aggregates(few)[0]).count() == fan_out(events, sub_aggregates(many)[0]).count() > 0
    long = long_partials(events, many)
    for spec in (many[0], many[7], many[-1]):
        assert rows(meter_partials(long, spec)) == rows(minute_partials(events, spec)), spec.slug


def test_more_value_properties_than_slots(spark):
    events = usage_events(spark, SF_SMALL)
    names = ["amount"] + [f"other{i}" for i in range(SLOTS)] + ["k"]
    specs = [MeterSpec(f"m{i}", "app.purchase", "sum", name, ("page",)) for i, name in enumerate(names)]
    specs.append(MeterSpec("again", "app.purchase", "max", names[-1], ("page",)))
    parts, meters = sub_aggregates(specs)
    assert [len(p[3]) for p in parts] == [SLOTS, 2] and meters[-1][0] == meters[-2][0]
    long = long_partials(events, specs)
    for spec in (specs[0], specs[1], specs[-1]):
        assert rows(meter_partials(long, spec)) == rows(minute_partials(events, spec)), spec.slug
