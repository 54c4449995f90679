"""Meter spec and meter query validation, time-range rounding."""

import datetime as dt

import pytest

from meterkit.plans.spec import MeterQuery, MeterQueryError, MeterSpec, MeterSpecError

SPEC = MeterSpec("api_sum", "api.sum", "sum", "tokens", ("llm", "persona"))


def test_count_meter_blanks_value_property():
    spec = MeterSpec("c", "t", "count", "ignored", ("p",))
    assert spec.value_property is None
    assert spec.validate() is spec


@pytest.mark.parametrize("kwargs", [
    dict(aggregation="median", value_property="v"),
    dict(aggregation="sum", value_property=None),
    dict(aggregation="sum", value_property="v", properties=()),
    dict(aggregation="sum", value_property="v", properties=("user",)),
    dict(aggregation="sum", value_property="v", properties=("batch_id",)),
    dict(aggregation="sum", value_property="v", properties=("sum_v",)),
    dict(aggregation="unique_count", value_property="v", unique_mode="bogus"),
])
def test_invalid_specs(kwargs):
    kwargs.setdefault("properties", ("p",))
    with pytest.raises(MeterSpecError):
        MeterSpec("m", "t", **kwargs).validate()


def test_dimensions_sorted_and_required():
    spec = MeterSpec("m", "t", "avg", "value", ("zeta", "alpha", "zeta"))
    assert spec.dimensions == ("alpha", "zeta")
    assert spec.required_properties == ("alpha", "value", "zeta")


def t(*a):
    return dt.datetime(*a)


@pytest.mark.parametrize("size,frm,to,exp_from,exp_to", [
    ("minute", t(2023, 1, 1, 0, 0, 30), t(2023, 1, 2, 0, 0, 45), t(2023, 1, 1), t(2023, 1, 2)),
    ("hour", t(2023, 1, 1, 5, 30), t(2023, 1, 2, 7, 10), t(2023, 1, 1, 5), t(2023, 1, 2, 8)),
    ("hour", t(2023, 1, 1, 5), t(2023, 1, 2, 7), t(2023, 1, 1, 5), t(2023, 1, 2, 7)),
    ("day", t(2023, 1, 1, 5, 30), t(2023, 1, 2, 0, 0, 1), t(2023, 1, 1), t(2023, 1, 3)),
    ("day", t(2023, 1, 1), t(2023, 1, 2), t(2023, 1, 1), t(2023, 1, 2)),
    (None, t(2023, 1, 1, 0, 0, 30), t(2023, 1, 2, 0, 0, 45), t(2023, 1, 1, 0, 0, 30), t(2023, 1, 2, 0, 0, 45)),
])
def test_bounds_rounding(size, frm, to, exp_from, exp_to):
    assert MeterQuery(size, frm, to).bounds() == (exp_from, exp_to)


def test_bounds_normalise_offsets_to_utc():
    plus2 = dt.timezone(dt.timedelta(hours=2))
    q = MeterQuery("day", dt.datetime(2023, 1, 2, 1, 0, tzinfo=plus2), dt.datetime(2023, 1, 3, 1, 0, tzinfo=plus2))
    # 2023-01-01T23:00Z .. 2023-01-02T23:00Z
    assert q.bounds() == (t(2023, 1, 1), t(2023, 1, 3))


@pytest.mark.parametrize("q", [
    MeterQuery("minute", t(2023, 1, 1), t(2023, 1, 2), window_time_zone="Europe/Paris"),
    MeterQuery("week", t(2023, 1, 1), t(2023, 1, 2)),
    MeterQuery("hour", None, t(2023, 1, 2)),
    MeterQuery("hour", t(2023, 1, 1), None),
    MeterQuery(None, group_by=("referrer",)),
    MeterQuery(None, filters={"referrer": ["google"]}),
])
def test_invalid_queries(q):
    with pytest.raises(MeterQueryError):
        q.validate(SPEC)


def test_empty_filter_list_is_skipped():
    MeterQuery(None, filters={"unknown": []}).validate(SPEC)
    MeterQuery("minute", t(2023, 1, 1), t(2023, 1, 2), group_by=("llm", "organization"),
               filters={"persona": ["a", "b"], "user": ["u"]}, window_time_zone="UTC").validate(SPEC)


def test_repeated_group_by_is_one_dimension():
    assert MeterQuery(None, group_by=("page", "user", "page")).group_by == ("page", "user")
