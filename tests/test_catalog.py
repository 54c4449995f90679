"""Catalog operators on small hand-made tables (C1-C16, C20-C22) and paging edges."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from meterkit.operators import catalog as cat
from meterkit.plans.requests import page_from_request


def ts(d):
    return dt.datetime(2024, 1, d)


@pytest.fixture(scope="module")
def plans(spark):
    return spark.createDataFrame(
        [("p1", "gold", "standard", "t1", ts(1), None), ("p2", "old", "custom", "t1", ts(2), ts(9)),
         ("p3", "blue", "standard", "t2", ts(3), None)],
        "id string, slug string, type string, tenant_slug string, created_at timestamp, archived_at timestamp")


@pytest.fixture(scope="module")
def features(spark):
    return spark.createDataFrame(
        [("f1", "api", "calls", "metered", "{}", "t1", ts(1)), ("f2", "sso", "sso", "static", "{}", "t1", ts(2)),
         ("f3", "api", "calls", "metered", "{}", "t2", ts(3))],
        "id string, slug string, name string, type string, config string, tenant_slug string, created_at timestamp")


@pytest.fixture(scope="module")
def plan_features(spark):
    return spark.createDataFrame(
        [("pf1", "p1", "f1", None, ts(4)), ("pf2", "p1", "f2", None, ts(5)), ("pf3", "p2", "f1", None, ts(6))],
        "id string, plan_id string, feature_id string, config string, created_at timestamp")


@pytest.fixture(scope="module")
def quotas(spark):
    return spark.createDataFrame(
        [("q1", "pf1", 100, "month", None, "block"), ("q2", "pf2", 5, "custom", None, "none"),
         ("q3", "pf3", 0, "day", 30, "warn"), ("q4", "pf3", 1, "hourly", None, "none")],
        "id string, plan_feature_id string, limit_value long, reset_period string, "
        "custom_period_minutes long, action_at_limit string")


@pytest.mark.parametrize("page,limit,offset,norm", [
    (1, 20, 0, (1, 20)), (0, 20, 0, (1, 20)), (3, 10, 20, (3, 10)), (2, 0, 20, (2, 20)), (2, 101, 20, (2, 20)),
    (2, 100, 100, (2, 100)), (-4, 5, 0, (1, 5)), (None, None, 0, (1, 20)),
])
def test_page_rule_of_requests(page, limit, offset, norm):
    p = page_from_request(page, limit)
    assert p.offset == offset
    assert (p.page, p.limit) == norm


def test_operators_honour_any_page_or_raise(spark):
    df = spark.range(400).selectExpr("cast(id as string) as id", "'t' as tenant_slug", "timestamp '2024-01-01' as created_at")
    assert cat.paged(df, ["tenant_slug"], cat.newest_first(), cat.Page(1, 250)).count() == 250
    for bad in ((0, 5), (1, 0)):
        with pytest.raises(ValueError):
            cat.Page(*bad)


def test_total_of_an_empty_page(spark, plans):
    out = cat.plans_page(plans, cat.Page(5, 10)).collect()
    assert sorted((r.tenant_slug, r.total, r.id) for r in out) == [("t1", 2, None), ("t2", 1, None)]


def test_paging_beyond_end_and_ties(spark):
    df = spark.createDataFrame([(f"m{i}", "t", ts(1 + i % 3)) for i in range(7)],
                               "id string, tenant_slug string, created_at timestamp")
    first = [r.id for r in cat.paged(df, ["tenant_slug"], cat.newest_first(), cat.Page(1, 3))
             .orderBy("position").collect()]
    assert first == ["m5", "m2", "m4"]
    assert cat.paged(df, ["tenant_slug"], cat.newest_first(), cat.Page(3, 3)).count() == 1
    assert cat.paged(df, ["tenant_slug"], cat.newest_first(), cat.Page(4, 3)).count() == 0
    assert [r.id for r in cat.page_of(df, cat.newest_first(), cat.Page(1, 3)).collect()] == first


def test_plans_page_total_follows_filters(spark, plans):
    out = cat.plans_page(plans, archived=False).collect()
    assert sorted((r.id, r.total) for r in out) == [("p1", 1), ("p3", 1)]
    assert {r.id for r in cat.plans_page(plans, tenant="t1", archived=True).collect()} == {"p2"}


def test_plan_feature_listing_and_entitlements(spark, plans, features, plan_features, quotas):
    rows = cat.plan_features_listing(plan_features, features, plans, plan_id="p1", feature_type="metered").collect()
    assert [(r.plan_feature_id, r.feature_type) for r in rows] == [("pf1", "metered")]
    ent = {(r.plan_feature_id, r.limit_value) for r in
           cat.entitlements(plan_features, features, plans, quotas).collect()}
    assert ent == {("pf1", 100), ("pf2", 5), ("pf3", 0), ("pf3", 1)}


def test_tenant_link_check_and_resolution(spark, plans, features, plan_features):
    req = spark.createDataFrame([("p1", "f1", "t1"), ("p1", "f3", "t1"), ("p3", "f1", "t1"), ("p9", "f1", "t1")],
                                "plan_id string, feature_id string, tenant_slug string")
    allowed = {(r.plan_id, r.feature_id): r.allowed for r in cat.tenant_link_check(req, plans, features).collect()}
    assert allowed == {("p1", "f1"): True, ("p1", "f3"): False, ("p3", "f1"): False, ("p9", "f1"): False}
    ids = [(r.plan_id, r.plan_feature_id) for r in cat.plan_feature_ids(req, plan_features, plans, features).collect()]
    assert ids == [("p1", "pf1")]


def test_quota_rules(spark, plan_features, features, quotas):
    assert {r.id for r in cat.unmetered_quotas(quotas, plan_features, features).collect()} == {"q2"}
    got = sorted((r.id, r.violation) for r in cat.quota_violations(quotas).collect())
    assert got == [("q2", "custom_without_minutes"), ("q3", "duplicate_plan_feature"),
                   ("q3", "minutes_without_custom"), ("q3", "non_positive_limit"), ("q3", "unknown_action"),
                   ("q4", "duplicate_plan_feature"), ("q4", "unknown_reset_period")]


def test_assignment_listings_and_checks(spark, plans):
    a = spark.createDataFrame(
        [("a1", "p1", "o1", None, ts(1), None, ts(1)), ("a2", "p1", None, "u1", ts(2), ts(20), ts(2)),
         ("a3", "p2", "o1", None, ts(3), ts(4), ts(3)), ("a4", "p3", "o2", "u2", ts(9), ts(4), ts(4)),
         ("a5", "p1", "o1", None, ts(5), ts(6), ts(5))],
        "id string, plan_id string, organization_id string, user_id string, valid_from timestamp, "
        "valid_until timestamp, created_at timestamp")
    # open-ended rows match an upper bound, as the reference's zero-time sentinel does
    got = {r.id for r in cat.assignments_page(a, plans, tenant="t1", valid_until_lte=ts(10)).collect()}
    assert got == {"a1", "a3", "a5"}
    assert {r.id for r in cat.active_assignments_page(a, plans, tenant="t1").collect()} == {"a1", "a2", "a5"}
    req = a.select("id", "plan_id")
    assert {r.id for r in cat.archived_plan_rejects(req, plans).collect()} == {"a3"}
    v = sorted((r.id, r.violation) for r in cat.assignment_violations(a).collect())
    assert v == [("a1", "duplicate_plan_organization"), ("a4", "not_exactly_one_entity"),
                 ("a4", "valid_from_after_valid_until"), ("a5", "duplicate_plan_organization")]


def test_history_bounds(spark, plans):
    h = spark.createDataFrame(
        [("h1", "CREATE", "p1", None, "u1", ts(1), None, ts(1)), ("h2", "UPDATE", "p1", None, "u1", ts(5), ts(8), ts(2)),
         ("h3", "DELETE", "p3", None, "u1", ts(5), ts(8), ts(3))],
        "id string, action string, plan_id string, organization_id string, user_id string, "
        "valid_from timestamp, valid_until timestamp, created_at timestamp")
    out = cat.history_page(h, plans, tenant="t1", valid_until_before=ts(9), valid_from_after=ts(1))
    assert [r.id for r in out.orderBy("position").collect()] == ["h1", "h2"]
    assert [r.id for r in cat.history_page(h, plans, action="DELETE").collect()] == ["h3"]


def test_cascade_delete(spark, plans, features, plan_features, quotas):
    a = spark.createDataFrame([("a1", "p2"), ("a2", "p1")], "id string, plan_id string")
    gone = sorted((r.entity, r.id) for r in cat.cascade_delete(
        plans, features, plan_features, quotas, a, deleted_features=features.where("id = 'f1'")).collect())
    assert gone == [("feature", "f1"), ("plan_feature", "pf1"), ("plan_feature", "pf3"),
                    ("quota", "q1"), ("quota", "q3"), ("quota", "q4")]


def test_assignments_of_plan_and_entity(spark, plans):
    a = spark.createDataFrame(
        [("a1", "p1", "o1", None), ("a2", "p1", None, "u1"), ("a3", "p3", None, "u1")],
        "id string, plan_id string, organization_id string, user_id string")
    assert {r.id for r in cat.assignments_of(a, plans, plan_id="p1").collect()} == {"a1", "a2"}
    assert {r.id for r in cat.assignments_of(a, plans, user_id="u1").collect()} == {"a2", "a3"}
    assert {r.id for r in cat.assignments_of(a, plans, tenant="t2").collect()} == {"a3"}


def test_deep_pages_sort_single_ranges(spark):
    """One tenant holds two thirds of the rows, one is small, one has no name.
    Pages beyond DEEP equal the plain window's, and no task sorts a tenant."""
    n = 36_000
    rows = spark.range(n).select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") % 3 < 2, "hot").when(F.col("id") % 30 == 2, "small").alias("tenant_slug"),
        F.timestamp_seconds(F.col("id") * 7919 % 5000).alias("created_at"))
    for number in (120, 240, 400):  # within all but the small one; the hot one's last; past the end
        page = cat.Page(number, 100)
        assert page.offset + page.limit > cat.DEEP
        deep = cat.paged_with_total(rows, ["tenant_slug"], cat.newest_first(), page)
        plain = (cat.totals(rows, ["tenant_slug"])
                 .join(cat.paged(rows, ["tenant_slug"], cat.newest_first(), page), ["tenant_slug"], "left"))
        assert deep.columns == plain.columns
        assert sorted(deep.collect(), key=repr) == sorted(plain.collect(), key=repr)
    deep = cat.deep_page_with_total(rows, ["tenant_slug"], cat.newest_first(), cat.Page(120, 100), ranges=24)
    windows = [w for w in deep._jdf.queryExecution().optimizedPlan().toString().splitlines() if "row_number()" in w]
    assert windows and all("__range" in w for w in windows)
