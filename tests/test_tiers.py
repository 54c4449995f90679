"""Hour and day tiers: the same answers from fewer rows."""

import datetime as dt

from meterkit.operators.query import query_rollup
from meterkit.operators.rollup import minute_partials
from meterkit.operators.tiers import build_tier, decompose, query_tiers
from meterkit.plans.spec import MeterQuery, MeterSpec
from meterkit.sources.fixtures import usage_events
from pyspark.sql import functions as F

from conftest import SF_CHECK, SF_SMALL

T = dt.datetime


def test_ranges_are_cut_as_coarse_as_fits():
    sizes = ["day", "hour", "minute"]
    assert decompose(T(2024, 1, 1, 22, 30), T(2024, 1, 4, 1, 5), sizes) == [
        ("minute", T(2024, 1, 1, 22, 30), T(2024, 1, 1, 23)), ("hour", T(2024, 1, 1, 23), T(2024, 1, 2)),
        ("day", T(2024, 1, 2), T(2024, 1, 4)), ("hour", T(2024, 1, 4), T(2024, 1, 4, 1)),
        ("minute", T(2024, 1, 4, 1), T(2024, 1, 4, 1, 5))]
    assert decompose(T(2024, 1, 1, 1, 10), T(2024, 1, 1, 1, 20), sizes) == [
        ("minute", T(2024, 1, 1, 1, 10), T(2024, 1, 1, 1, 20))]
    assert decompose(None, None, sizes) == [("day", None, None)]
    assert decompose(None, T(2024, 1, 2), ["hour", "minute"]) == [("hour", None, T(2024, 1, 2))]
    assert decompose(T(2024, 1, 2), T(2024, 1, 2), sizes) == [("minute", T(2024, 1, 2), T(2024, 1, 2))]


def rows(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def test_same_answers_from_tiers(spark):
    events = usage_events(spark, SF_SMALL)
    odd = (T(2024, 1, 3, 5, 17), T(2024, 1, 20, 21, 44))
    for spec in (MeterSpec("a", "app.purchase", "avg", "amount", ("page",)),
                 MeterSpec("u", "app.click", "unique_count", "k", ("page",)),
                 MeterSpec("m", "app.purchase", "max", "amount", ("page",))):
        minutes = minute_partials(events, spec).cache()
        hours = build_tier(minutes, spec, "hour").cache()
        tiers = {"minute": minutes, "hour": hours, "day": build_tier(hours, spec, "day").cache()}
        for q in (MeterQuery(None, *odd, group_by=("page",)), MeterQuery("day", *odd, group_by=("organization",)),
                  MeterQuery("hour", *odd, filters={"page": []})):
            got = rows(query_tiers(tiers, spec, q))
            assert got == rows(query_rollup(minutes, spec, q)) and got, (spec.slug, q)


def test_long_ranges_read_a_tenth_of_the_rows(spark):
    """A busy key has a row per minute in the rollup and one per day in its tier."""
    events = usage_events(spark, SF_CHECK).withColumns({"organization": F.lit("o"), "user": F.lit("u")})
    spec = MeterSpec("n", "app.click", "count")
    minutes = minute_partials(events, spec)
    assert build_tier(minutes, spec, "day").count() * 10 <= minutes.count()
