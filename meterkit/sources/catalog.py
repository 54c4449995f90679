"""Catalog tables (meters, plans, features, plan-features, quotas,
assignments, assignment history) derived from the driver's TPC-H-like
tables, so catalog operators run on data that grows with the scale factor.

Open-ended validity is stored as NULL, not as the year-1 sentinel the
reference writes (PySpark cannot collect year 1); filters treat NULL like
that sentinel where it matters (see ``operators.catalog``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterkit.sources.fixtures import table

# 2024-01-01T00:00:00Z as epoch seconds, the origin of fixture times.
EPOCH_2024 = 1704067200
DAY = 86400

# Quota reset periods and actions the reference accepts.
RESET_PERIODS = ("day", "week", "month", "year", "custom", "rolling", "never")
LIMIT_ACTIONS = ("none", "block", "throttle")
AGGREGATION_BY_SIZE = ("count", "sum", "avg", "min", "max", "unique_count")


def at_seconds(seconds: Column) -> Column:
    return F.timestamp_seconds(F.lit(EPOCH_2024) + seconds)


def _pick(values: tuple[str, ...], index: Column) -> Column:
    expr = None
    for i, v in enumerate(values):
        expr = F.when(index == i, F.lit(v)) if expr is None else expr.when(index == i, F.lit(v))
    return expr


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(
        "r_regionkey", F.lower(F.replace(F.col("r_name"), F.lit(" "), F.lit("_"))).alias("tenant_slug"))


def meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meter registry: one meter per part, tenant by ``p_partkey % 5``."""
    part = table(spark, sf_dir, "part")
    t = tenants(spark, sf_dir)
    first, second = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    aggregation = _pick(AGGREGATION_BY_SIZE, F.col("p_size") % 6)
    value_property = (F.when(aggregation == "count", F.lit(None).cast("string"))
                      .when(F.col("p_partkey") % 3 == 0, F.lit("amount"))
                      .when(F.col("p_partkey") % 3 == 1, F.lit("tokens"))
                      .otherwise(F.lit("latency_ms")))
    properties = F.when(F.col("p_size") > 25, F.array(first, F.lit("region"))).otherwise(F.array(first))
    return part.join(t, (F.col("p_partkey") % 5) == F.col("r_regionkey")).select(
        F.concat(F.lit("mtr_"), F.col("p_partkey").cast("string")).alias("id"),
        F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("slug"),
        F.col("p_name").alias("name"),
        F.concat(second, F.lit("."), F.lower("p_type")).alias("event_type"),
        value_property.alias("value_property"),
        properties.alias("properties"),
        aggregation.alias("aggregation"),
        "tenant_slug",
        at_seconds(F.col("p_partkey")).alias("created_at"),
    )


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: one plan per nation, tenant = its region; every fifth archived."""
    nation = table(spark, sf_dir, "nation")
    t = tenants(spark, sf_dir)
    n = F.col("n_nationkey")
    created = at_seconds(n * DAY)
    return nation.join(t, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("plan_"), n.cast("string")).alias("id"),
        F.lower(F.replace(F.col("n_name"), F.lit(" "), F.lit("_"))).alias("slug"),
        F.col("n_name").alias("name"),
        F.when(n % 3 == 0, F.lit("custom")).otherwise(F.lit("standard")).alias("type"),
        "tenant_slug",
        created.alias("created_at"),
        F.when(n % 5 == 0, at_seconds(n * DAY + 100 * DAY)).alias("archived_at"),
    )


def _brand_no() -> Column:
    return F.substring("p_brand", 7, 10).cast("int")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feature per (brand, tenant) where the tenant sells the brand
    (``p_partkey % 5`` picks the tenant); odd brands are metered."""
    part = table(spark, sf_dir, "part")
    t = tenants(spark, sf_dir)
    pairs = (part.join(t, (F.col("p_partkey") % 5) == F.col("r_regionkey"))
             .select("p_brand", _brand_no().alias("b"), "r_regionkey", "tenant_slug").distinct())
    metered = F.col("b") % 2 == 1
    return pairs.select(
        F.concat(F.col("p_brand"), F.lit("@"), F.col("tenant_slug")).alias("id"),
        F.concat(F.lit("f"), F.col("b").cast("string"), F.lit("_"), F.col("r_regionkey").cast("string")).alias("slug"),
        F.col("p_brand").alias("name"),
        F.when(metered, F.lit("metered")).otherwise(F.lit("static")).alias("type"),
        F.when(metered, F.lit('{"unit":"call"}')).otherwise(F.lit("{}")).alias("config"),
        "tenant_slug",
        at_seconds((F.col("b") * 5 + F.col("r_regionkey")) * 60).alias("created_at"),
    )


def link_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to attach a feature to a plan: for every supplied part, the
    supplier's nation plan and the part's brand in the part's tenant. The
    request is made within the plan's tenant; some features belong to
    another tenant (C9 finds them)."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    links = (li.join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
             .join(part, F.col("l_partkey") == F.col("p_partkey"))
             .select(F.col("s_nationkey").alias("n"), "p_brand", _brand_no().alias("b"),
                     (F.col("p_partkey") % 5).alias("fr"))
             .distinct())
    t = tenants(spark, sf_dir)
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    plan_tenant = nation.join(t, F.col("n_regionkey") == F.col("r_regionkey")) \
        .select(F.col("n_nationkey").alias("n"), F.col("tenant_slug").alias("tenant_slug"))
    feature_tenant = t.select(F.col("r_regionkey").alias("fr"), F.col("tenant_slug").alias("feature_tenant"))
    return (links.join(plan_tenant, "n").join(feature_tenant, "fr")
            .select(
                F.concat(F.lit("plan_"), F.col("n").cast("string")).alias("plan_id"),
                F.concat(F.col("p_brand"), F.lit("@"), F.col("feature_tenant")).alias("feature_id"),
                "tenant_slug", "n", "b", "fr",
                (F.col("tenant_slug") == F.col("feature_tenant")).alias("same_tenant")))


def plan_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same-tenant link requests."""
    links = link_requests(spark, sf_dir).where("same_tenant")
    return links.select(
        F.concat(F.col("plan_id"), F.lit(":"), F.col("feature_id")).alias("id"),
        "plan_id", "feature_id",
        F.when(F.col("b") % 4 == 0, F.lit('{"visible":true}')).alias("config"),
        at_seconds((F.col("n") * 1000 + F.col("b") * 5 + F.col("fr")) * 60).alias("created_at"),
    )


def quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotas on plan-features: one per metered link, plus deliberate faults
    (a quota on a static feature, custom period without minutes, minutes
    without custom, zero limit, a second quota on one plan-feature)."""
    links = link_requests(spark, sf_dir).where("same_tenant")
    n, b = F.col("n"), F.col("b")
    chosen = links.where((b % 2 == 1) | ((n + b) % 7 == 0))
    period = _pick(RESET_PERIODS, (n + b) % 7)
    minutes = (F.when((period == "custom") & ((n * b) % 11 != 0), (b * 60).cast("long"))
               .when((period != "custom") & ((n * b) % 13 == 0), F.lit(30).cast("long")))
    pf_id = F.concat(F.col("plan_id"), F.lit(":"), F.col("feature_id"))
    base = chosen.select(
        F.concat(F.lit("q_"), pf_id).alias("id"),
        pf_id.alias("plan_feature_id"),
        F.when((n + b) % 17 == 0, F.lit(0)).otherwise(b * 1000).cast("long").alias("limit_value"),
        period.alias("reset_period"),
        minutes.alias("custom_period_minutes"),
        _pick(LIMIT_ACTIONS, b % 3).alias("action_at_limit"),
        at_seconds((n * 1000 + b * 5 + F.col("fr")) * 60 + 1).alias("created_at"),
        ((n * b) % 19 == 0).alias("__dup"),
    )
    dups = base.where("__dup").withColumn("id", F.concat(F.lit("q2_"), F.col("plan_feature_id"))) \
        .withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 1 SECOND"))
    return base.unionByName(dups).drop("__dup")


def _entity(custkey: Column, prefix_org: str = "org_", prefix_user: str = "usr_"):
    org = F.when(custkey % 2 == 0, F.concat(F.lit(prefix_org), custkey.cast("string")))
    user = F.when(custkey % 2 == 1, F.concat(F.lit(prefix_user), custkey.cast("string")))
    return org.alias("organization_id"), user.alias("user_id")


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One assignment per customer to its nation's plan; even customers
    as organizations, odd as users; every seventh open-ended."""
    c = F.col("c_custkey")
    valid_from = at_seconds((c % 365) * DAY)
    org, user = _entity(c)
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("asg_"), c.cast("string")).alias("id"),
        F.concat(F.lit("plan_"), F.col("c_nationkey").cast("string")).alias("plan_id"),
        org, user,
        valid_from.alias("valid_from"),
        F.when(c % 7 != 0, at_seconds((c % 365) * DAY + 90 * DAY)).alias("valid_until"),
        at_seconds(c).alias("created_at"),
    )


def assignment_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One history row per order, action by order status."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    o = F.col("o_orderkey")
    start = F.col("o_orderdate").cast("timestamp")
    org, user = _entity(F.col("c_custkey"))
    return orders.join(cust, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("h_"), o.cast("string")).alias("id"),
        F.when(F.col("o_orderstatus") == "O", F.lit("CREATE"))
        .when(F.col("o_orderstatus") == "P", F.lit("UPDATE"))
        .otherwise(F.lit("DELETE")).alias("action"),
        F.concat(F.lit("asg_"), F.col("c_custkey").cast("string")).alias("assignment_id"),
        F.concat(F.lit("plan_"), F.col("c_nationkey").cast("string")).alias("plan_id"),
        org, user,
        start.alias("valid_from"),
        F.when(o % 7 != 0, start + F.expr("INTERVAL 90 DAYS")).alias("valid_until"),
        F.timestamp_seconds(F.unix_seconds(start) + o % DAY).alias("created_at"),
    )


def assignment_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignment change requests, one per order, applied in
    ``(requested_at, seq)`` order per (plan, organization/user) key.

    Status ``P`` asks to CREATE, ``F`` with ``o_orderkey % 5 = 0`` to DELETE,
    anything else to UPDATE. Every ninth order names the next nation's plan
    (a key with no assignment yet); every 97th names both an organization and
    a user. Dates are chosen so each C19 rule and the C20/C21 checks fire.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    o, c = F.col("o_orderkey"), F.col("c_custkey")
    action = (F.when(F.col("o_orderstatus") == "P", F.lit("CREATE"))
              .when((F.col("o_orderstatus") == "F") & (o % 5 == 0), F.lit("DELETE"))
              .otherwise(F.lit("UPDATE")))
    nation = F.when(o % 9 == 0, (F.col("c_nationkey") + 1) % 25).otherwise(F.col("c_nationkey"))
    both = o % 97 == 0
    org = F.when((c % 2 == 0) | both, F.concat(F.lit("org_"), c.cast("string")))
    user = F.when((c % 2 == 1) | both, F.concat(F.lit("usr_"), c.cast("string")))
    create_from = at_seconds((o % 365) * DAY)
    update_from = at_seconds((c % 365 + o % 120 - 20) * DAY)
    valid_from = (F.when(action == "CREATE", create_from)
                  .when((action == "UPDATE") & (o % 3 != 0), update_from))
    valid_until = (F.when(action == "CREATE",
                          F.when(o % 11 == 0, at_seconds((o % 365) * DAY - DAY))
                          .when(o % 7 != 0, at_seconds((o % 365) * DAY + 30 * DAY)))
                   .when((action == "UPDATE") & (o % 4 != 0), at_seconds((c % 365 + 30 + o % 90) * DAY)))
    requested_at = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + o % DAY)
    return orders.join(cust, F.col("o_custkey") == c).select(
        F.concat(F.lit("chg_"), o.cast("string")).alias("change_id"),
        o.alias("seq"),
        action.alias("action"),
        F.concat(F.lit("plan_"), nation.cast("string")).alias("plan_id"),
        org.alias("organization_id"),
        user.alias("user_id"),
        valid_from.alias("valid_from"),
        valid_until.alias("valid_until"),
        ((action == "UPDATE") & (o % 13 == 0)).alias("clear_valid_until"),
        requested_at.alias("requested_at"),
    )
