"""Ingest validation cases after the reference's producer tests."""

import pytest
from pyspark.sql import functions as F

from meterkit.operators import ingest

FIELDS = "id string, type string, source string, organization string, user string, timestamp string, properties string"
TS = "2024-05-06T12:00:00Z"


@pytest.fixture(scope="module")
def meters(spark):
    # type1 needs propA, propB and valueProp; type2 needs cost; type3 needs nothing.
    return spark.createDataFrame(
        [("m1", "type1", "sum", "valueProp", ["propA", "propB"], "t"),
         ("m2", "type2", "sum", "cost", [], "t"),
         ("m3", "type3", "count", None, [], "t"),
         ("m4", "type1", "count", None, ["propA"], "other_tenant")],
        "slug string, event_type string, aggregation string, value_property string, "
        "properties array<string>, tenant_slug string")


def ev(type_="type1", props='{"propA":"a","propB":"b","valueProp":1}', org="org-default",
       user="user-default", ts=TS, id_="e"):
    return (id_, type_, "src", org, user, ts, props)


def reasons(spark, meters, events, **kw):
    df = spark.createDataFrame(events, FIELDS)
    out = ingest.validate(df, meters, tenant="t", **kw).orderBy("id").collect()
    return [(r.id, r.reason, list(r.missing) if r.missing is not None else None) for r in out]


CASES = [
    ("all_valid", ev(), None, None),
    ("empty_type", ev(type_=""), "missing_event_type", None),
    ("unknown_type", ev(type_="nope"), "missing_meter", None),
    ("missing_property", ev(props='{"propA":"a","valueProp":1}'), "missing_properties", ["propB"]),
    ("empty_string_property", ev(props='{"propA":"","propB":"b","valueProp":1}'), "missing_properties", ["propA"]),
    ("null_property", ev(props='{"propA":null,"propB":"b","valueProp":1}'), "missing_properties", ["propA"]),
    ("empty_array_property", ev(props='{"propA":[],"propB":"b","valueProp":1}'), "missing_properties", ["propA"]),
    ("empty_object_property", ev(props='{"propA":{},"propB":"b","valueProp":1}'), "missing_properties", ["propA"]),
    ("zero_and_false_present", ev(props='{"propA":0,"propB":false,"valueProp":0}'), None, None),
    ("bracket_text_present", ev(props='{"propA":"[]","propB":[null],"valueProp":"{}"}'), None, None),
    ("broken_json", ev(props='{"propA":'), "invalid_properties", None),
    ("array_json", ev(props='[1,2]'), "invalid_properties", None),
    ("properties_empty_text", ev(props=""), "missing_properties", ["propA", "propB", "valueProp"]),
    ("properties_empty_object", ev(props="{}"), "missing_properties", ["propA", "propB", "valueProp"]),
    ("properties_null_text", ev(props="null"), "missing_properties", ["propA", "propB", "valueProp"]),
    ("value_only_meter", ev(type_="type2", props='{"cost":3}'), None, None),
    ("meter_without_properties", ev(type_="type3", props='{broken'), None, None),
    ("missing_organization", ev(org=""), "invalid_field", None),
    ("bad_timestamp", ev(ts="06/05/2024 12:00"), "invalid_timestamp", None),
    ("other_tenant_only", ev(type_="type1", props='{"propA":"a","propB":"b","valueProp":1}'), None, None),
]


@pytest.mark.parametrize("name,event,reason,missing", CASES, ids=[c[0] for c in CASES])
def test_case(spark, meters, name, event, reason, missing):
    [(_, got_reason, got_missing)] = reasons(spark, meters, [event])
    assert got_reason == reason
    assert got_missing == missing


def test_nil_event_and_rule_order(spark, meters):
    out = reasons(spark, meters, [(None,) * 7, ev(type_="", org="", id_="x")])
    assert [r[1] for r in out] == ["nil_event", "missing_event_type"]


def test_tenant_scopes_registry(spark, meters):
    df = spark.createDataFrame([ev(props='{"propA":"a"}')], FIELDS)
    [row] = ingest.validate(df, meters, tenant="other_tenant").collect()
    assert row.reason is None


def test_required_properties_keeps_types_without_requirements(spark, meters):
    req = {r.event_type: list(r.required) for r in ingest.required_properties(meters.where("tenant_slug='t'")).collect()}
    assert req == {"type1": ["propA", "propB", "valueProp"], "type2": ["cost"], "type3": []}


def test_split_and_counts(spark, meters):
    batch = [ev(id_="a"), ev(id_="b", type_="nope"), ev(id_="c", ts=""), ev(id_="", props='{"propA":"a"}')]
    df = spark.createDataFrame(batch, FIELDS)
    validated = ingest.validate(df, meters, tenant="t")
    valid, rejected = ingest.split(validated)
    assert valid.count() + rejected.count() == len(batch)
    got = {r.id: r for r in valid.collect()}
    assert set(got) == {"a", "c"}
    assert str(got["a"].timestamp) == "2024-05-06 12:00:00"
    assert got["c"].timestamp is not None
    counts = {r.reason: r.events for r in ingest.reason_counts(validated).collect()}
    assert counts == {None: 2, "missing_meter": 1, "missing_properties": 1}
    with pytest.raises(ingest.BatchRejected):
        ingest.ensure_all_valid(validated)
    ingest.ensure_all_valid(validated.where(F.col("reason").isNull()))


def test_timestamps_normalised_to_utc_seconds(spark, meters):
    df = spark.createDataFrame([ev(ts="2024-05-06T14:00:00.987+02:00")], FIELDS)
    [row] = ingest.typed_events(ingest.validate(df, meters, tenant="t")).collect()
    assert str(row.timestamp) == "2024-05-06 12:00:00"


def test_strict_ids_and_default_ids(spark, meters):
    df = spark.createDataFrame([ev(id_="not-a-uuid"), ev(id_="")], FIELDS)
    strict = ingest.validate(df, meters, tenant="t", strict_ids=True).orderBy("id").collect()
    assert [r.reason for r in strict] == [None, "invalid_field"]
    valid = ingest.typed_events(ingest.validate(df, meters, tenant="t")).collect()
    assert sorted(len(r.id) for r in valid) == [10, 36]


def test_publish_modes(spark, meters):
    good, bad = ev(id_="g"), ev(id_="b", type_="nope")
    valid, rejected = ingest.publish(spark.createDataFrame([good, bad], FIELDS), meters, tenant="t")
    assert (valid.count(), rejected.count()) == (1, 1)
    with pytest.raises(ingest.BatchRejected):
        ingest.publish(spark.createDataFrame([good, bad], FIELDS), meters, tenant="t", allow_partial_success=False)
    with pytest.raises(ingest.BatchError, match="every event"):
        ingest.publish(spark.createDataFrame([bad], FIELDS), meters, tenant="t")
    with pytest.raises(ingest.BatchError, match="names a type"):
        ingest.publish(spark.createDataFrame([ev(type_="")], FIELDS), meters, tenant="t")
    with pytest.raises(ingest.BatchError, match="no events"):
        ingest.publish(spark.createDataFrame([], FIELDS), meters, tenant="t")


@pytest.mark.parametrize("text,ok", [
    ("2024-05-06T12:00:00Z", True), ("2024-05-06T12:00:00.5-03:30", True), ("2024-05-06t12:00:00z", False),
    ("2024-05-06 12:00:00Z", False), ("2024-05-06T12:00:00", False), ("2024-13-06T12:00:00Z", False),
])
def test_rfc3339_only(spark, meters, text, ok):
    [(_, reason, _)] = reasons(spark, meters, [ev(ts=text)])
    assert (reason is None) == ok


def test_whole_registry_when_no_tenant(spark, meters):
    # type1 is metered by tenant t (propA, propB, valueProp) and other_tenant (propA):
    # without a tenant the requirements are the union, as for a shared event stream
    df = spark.createDataFrame([ev(props='{"propA":"a"}')], FIELDS)
    [row] = ingest.validate(df, meters.drop("tenant_slug")).collect()
    assert row.reason == "missing_properties" and list(row.missing) == ["propB", "valueProp"]


def test_read_catalog(spark, scratch_dir):
    from meterkit.sources.catalog_io import read_catalog
    spark.createDataFrame([("p1", "t")], "id string, tenant_slug string").write.parquet(scratch_dir + "/plan")
    assert read_catalog(spark, "plan", scratch_dir + "/plan").count() == 1
    with pytest.raises(ValueError):
        read_catalog(spark, "invoices", scratch_dir + "/plan")


def test_only_the_own_tenants_meters_apply(spark):
    registry = spark.createDataFrame(
        [("t", "a", "sum", "v", ["x"]), ("u", "a", "sum", "v", ["only_u"])],
        "tenant_slug string, event_type string, aggregation string, value_property string, properties array<string>")
    raw = spark.createDataFrame([("1", "a", "", "o", "u", "", '{"x":"1","v":"2"}')], FIELDS)
    assert ingest.validate(raw, registry, tenant="t").first().reason is None
    with pytest.raises(ValueError, match="tenants"):
        ingest.validate(raw, registry)
    both = raw.selectExpr("*", "explode(array('t', 'u', 'v')) as tenant_slug")
    got = {r.tenant_slug: (r.reason, r.missing) for r in ingest.validate(both, registry).collect()}
    assert got == {"t": (None, None), "u": ("missing_properties", ["only_u"]), "v": ("missing_meter", None)}
