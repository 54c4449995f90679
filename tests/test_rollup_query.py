"""Merge law and query semantics (M1-M12, Q1-Q18) on the sf0.001 events."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from meterkit.operators.query import query_events, query_rollup, result_range, shape_rows
from meterkit.operators.rollup import compact_partials, minute_partials, rollup_rejects
from meterkit.plans.spec import MeterQuery, MeterSpec
from meterkit.sources.fixtures import usage_events

from conftest import SF_SMALL

SPECS = {
    "count": MeterSpec("c", "app.click", "count", None, ("page",)),
    "sum": MeterSpec("s", "app.purchase", "sum", "amount", ("page",)),
    "avg": MeterSpec("a", "app.view", "avg", "amount", ("page", "k")),
    "min": MeterSpec("mi", "app.signup", "min", "amount", ("page",)),
    "max": MeterSpec("ma", "app.error", "max", "amount", ("page",)),
    "unique_count": MeterSpec("u", "app.click", "unique_count", "k", ("page",)),
}
FROM, TO = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 31)


def rows(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def events(spark):
    return usage_events(spark, SF_SMALL).cache()


@pytest.mark.parametrize("agg", list(SPECS))
@pytest.mark.parametrize("window", ["minute", "hour", "day", None])
def test_merge_law(spark, events, agg, window):
    spec = SPECS[agg]
    q = MeterQuery(window, FROM, TO, group_by=("organization",))
    merged = query_rollup(minute_partials(events, spec), spec, q)
    direct = query_events(events, spec, q)
    assert rows(merged) == rows(direct)
    assert merged.count() > 0


def test_value_is_double_and_columns_ordered(spark, events):
    spec = SPECS["count"]
    out = query_rollup(minute_partials(events, spec), spec, MeterQuery("day", FROM, TO, group_by=("page",)))
    assert out.columns == ["windowstart", "windowend", "value", "page"]
    assert dict(out.dtypes)["value"] == "double"


def test_filters_and_equality(spark, events):
    spec = SPECS["sum"]
    q = MeterQuery("hour", FROM, TO, group_by=("user",), filters={"page": ["p1", "p2"], "organization": ["org_3"]})
    out = query_rollup(minute_partials(events, spec), spec, q)
    assert out.where(~F.col("user").endswith("3")).count() == 0
    expected = (events.where("type = 'app.purchase' and organization = 'org_3'")
                .where(F.get_json_object("properties", "$.page").isin("p1", "p2")))
    total = out.agg(F.sum("value")).first()[0]
    exp = expected.agg(F.sum(F.get_json_object("properties", "$.amount").cast("double"))).first()[0]
    assert total == pytest.approx(exp)


def test_window_ends_follow_starts(spark, events):
    spec = SPECS["count"]
    for size, delta in (("hour", dt.timedelta(hours=1)), ("day", dt.timedelta(days=1))):
        out = query_rollup(minute_partials(events, spec), spec, MeterQuery(size, FROM, TO)).collect()
        assert all(r.windowend - r.windowstart == delta for r in out)
        assert len({r.windowstart for r in out}) == len(out)


def test_compaction_and_order_invariance(spark, events):
    spec = SPECS["avg"]
    whole = minute_partials(events, spec)
    parts = [minute_partials(events.where(F.abs(F.hash("id")) % 4 == i), spec) for i in range(4)]
    stacked = parts[3].unionByName(parts[1]).unionByName(parts[0]).unionByName(parts[2])
    q = MeterQuery("day", FROM, TO, group_by=("page",))
    assert rows(query_rollup(stacked, spec, q)) == rows(query_rollup(whole, spec, q))
    compacted = compact_partials(stacked, spec)
    assert compacted.count() == whole.count()
    assert rows(query_rollup(compacted, spec, q)) == rows(query_rollup(whole, spec, q))


def test_hll_close_to_exact(spark, events):
    exact = SPECS["unique_count"]
    approx = MeterSpec("u2", "app.click", "unique_count", "k", ("page",), unique_mode="hll")
    q = MeterQuery("day", FROM, TO)
    a = {r.windowstart: r.value for r in query_rollup(minute_partials(events, approx), approx, q).collect()}
    e = {r.windowstart: r.value for r in query_rollup(minute_partials(events, exact), exact, q).collect()}
    assert a.keys() == e.keys()
    assert all(abs(a[k] - e[k]) <= max(2, 0.05 * e[k]) for k in e)


def test_non_numeric_values_are_set_aside(spark):
    ev = spark.createDataFrame(
        [("1", "t", "o", "u", dt.datetime(2024, 1, 1, 0, 0, 5), '{"v":"2.5","p":"a"}'),
         ("2", "t", "o", "u", dt.datetime(2024, 1, 1, 0, 0, 9), '{"v":"abc","p":"a"}'),
         ("3", "t", "o", "u", dt.datetime(2024, 1, 1, 0, 1, 9), '{"v":"oops","p":"b"}'),
         ("4", "t", "o", "u", dt.datetime(2024, 1, 1, 0, 2, 9), '{"v":7,"p":"b"}')],
        "id string, type string, organization string, user string, timestamp timestamp, properties string")
    spec = MeterSpec("m", "t", "sum", "v", ("p",))
    parts = minute_partials(ev, spec).collect()
    assert sorted((r.p, r.sum_v) for r in parts) == [("a", 2.5), ("b", 7.0)]
    assert sorted(r.id for r in rollup_rejects(ev, spec).collect()) == ["2", "3"]
    total = query_rollup(minute_partials(ev, spec), spec, MeterQuery()).first()
    assert total.value == 9.5 and total.windowstart == dt.datetime(2024, 1, 1, 0, 0)


def test_json_extract_semantics(spark):
    ev = spark.createDataFrame(
        [("1", "t", "o", "u", dt.datetime(2024, 1, 1), '{"p":null,"q":12,"r":{"x":1}}'),
         ("2", "t", "o", "u", dt.datetime(2024, 1, 1), '{broken')],
        "id string, type string, organization string, user string, timestamp timestamp, properties string")
    spec = MeterSpec("m", "t", "count", None, ("p", "q", "r", "s"))
    got = sorted((r.p, r.q, r.r, r.s, r.cnt_v) for r in minute_partials(ev, spec).collect())
    assert got == [("", "", "", "", 1), ("", "12", '{"x":1}', "", 1)]


def test_result_range_and_shaping(spark, events):
    spec = SPECS["sum"]
    q = MeterQuery("day", dt.datetime(2024, 1, 3, 5, 30), dt.datetime(2024, 1, 20, 12), group_by=("organization",))
    out = query_rollup(minute_partials(events, spec), spec, q)
    rng = result_range(out, q).first()
    assert rng.window_start == dt.datetime(2024, 1, 3, 5, 30)
    assert rng.window_end == dt.datetime(2024, 1, 20, 12)
    empty = result_range(out.where("false"), q).first()
    assert (empty.window_start, empty.window_end) == (q.from_ts, q.to_ts)
    shaped = shape_rows(out, q).first()
    assert set(shaped.group_by) == {"organization"}


def test_count_of_values_when_enabled(spark):
    ev = spark.createDataFrame(
        [("1", "t", "o", "u", dt.datetime(2024, 1, 1, 0, 0, 5), '{"v":"2.5","p":"a"}'),
         ("2", "t", "o", "u", dt.datetime(2024, 1, 1, 0, 0, 9), '{"v":"abc","p":"a"}'),
         ("3", "t", "o", "u", dt.datetime(2024, 1, 1, 0, 1, 9), '{"p":"b"}'),
         ("4", "t", "o", "u", dt.datetime(2024, 1, 1, 0, 2, 9), '{"v":7,"p":"b"}')],
        "id string, type string, organization string, user string, timestamp timestamp, properties string")
    api = MeterSpec("m", "t", "count", "v", ("p",))
    assert api.value_property is None
    spec = MeterSpec("m", "t", "count", "v", ("p",), count_values=True).validate()
    q = MeterQuery("minute", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), group_by=("p",))
    merged = rows(query_rollup(minute_partials(ev, spec), spec, q))
    assert merged == rows(query_events(ev, spec, q))
    assert [(r[2], r[3]) for r in merged] == [(1.0, "a"), (1.0, "b")]
    assert sorted(r.id for r in rollup_rejects(ev, spec).collect()) == ["2", "3"]
    assert sum(r[2] for r in rows(query_rollup(minute_partials(ev, api), api, q))) == 4.0


@pytest.mark.parametrize("agg,expected", [("sum", None), ("avg", None), ("max", None), ("count", 0.0),
                                          ("unique_count", 0.0)])
def test_global_query_over_no_rows_agrees(spark, events, agg, expected):
    spec = SPECS[agg]
    q = MeterQuery(None, dt.datetime(2030, 1, 1), dt.datetime(2030, 1, 2))
    merged = query_rollup(minute_partials(events, spec), spec, q).collect()
    direct = query_events(events, spec, q).collect()
    assert [tuple(r) for r in merged] == [tuple(r) for r in direct] == [(None, None, expected)]


def test_property_names_with_dots_and_spaces(spark):
    ev = spark.createDataFrame(
        [("1", "t", "o", "u", dt.datetime(2024, 1, 1, 0, 0, 5), '{"user.id":"a","a b":"x","v":1}'),
         ("2", "t", "o", "u", dt.datetime(2024, 1, 1, 0, 0, 9), '{"user.id":"a","a b":"y","v":2}'),
         ("3", "t", "o", "u", dt.datetime(2024, 1, 1, 0, 1, 9), '{"user.id":"b","a b":"x","v":4}')],
        "id string, type string, organization string, user string, timestamp timestamp, properties string")
    spec = MeterSpec("m", "t", "sum", "v", ("user.id", "a b")).validate()
    q = MeterQuery("hour", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), group_by=("user.id",),
                   filters={"a b": ["x"]})
    merged = query_rollup(compact_partials(minute_partials(ev, spec), spec), spec, q)
    assert merged.columns == ["windowstart", "windowend", "value", "user.id"]
    assert sorted((r["user.id"], r["value"]) for r in merged.collect()) == [("a", 1.0), ("b", 4.0)]
    assert rows(merged) == rows(query_events(ev, spec, q))
    assert shape_rows(merged, q).first().group_by.keys() == {"user.id"}
