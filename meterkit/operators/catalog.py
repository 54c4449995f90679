"""Catalog analytics: counts, listings with paging, joins and consistency
checks over meters, plans, features, plan-features, quotas and assignments
(C1-C16, C20-C22).

The reference answers one tenant (and one plan, one page) per request. Each
operator here takes optional scalar filters; left unset, it runs over every
tenant at once, and paging becomes a per-tenant top-k (a window
``row_number`` whose ``rn <= k`` predicate Spark turns into a partial
per-task group limit before the shuffle, so a hot tenant never ships more than
``offset + limit`` rows per task).

Dimension sides (plans, features) are joined with ``bounded_broadcast``: a
row-count check first, a shuffle join beyond the bound.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterkit.operators.joins import bounded_broadcast
from meterkit.session import materialize
from meterkit.sources.catalog import LIMIT_ACTIONS, RESET_PERIODS

# Paging defaults of the reference's API.
DEFAULT_PAGE = 1
DEFAULT_LIMIT = 20
#: Pages that end beyond this many rows are not ranked by one window: Spark's
#: group limit before the shuffle is set to the same bound (``session``).
DEEP = 10_000


@dataclass(frozen=True)
class Page:
    """C4: ``page`` from 1, ``limit`` rows each. Any limit is honoured here; the
    API's bounds and defaults belong to requests (``requests.page_from_request``)."""
    page: int = DEFAULT_PAGE
    limit: int = DEFAULT_LIMIT

    def __post_init__(self):
        if self.page < 1 or self.limit < 1:
            raise ValueError("page and limit start at 1")

    @property
    def offset(self) -> int:
        return (self.page - 1) * self.limit


def _given(df: DataFrame, **conds) -> DataFrame:
    """``arg is null or col = arg`` -> the predicate only when given."""
    for name, value in conds.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def paged(df: DataFrame, partition: list[str], order: list[Column], page: Page,
          position: str = "position") -> DataFrame:
    """C4 for every partition key at once: rows ``offset+1 .. offset+limit``
    of each partition in ``order``, numbered from 1 in ``position``."""
    w = Window.partitionBy(*partition).orderBy(*order)
    ranked = df.withColumn(position, F.row_number().over(w).cast("long"))
    return ranked.where((F.col(position) > page.offset) & (F.col(position) <= page.offset + page.limit))


def page_of(df: DataFrame, order: list[Column], page: Page) -> DataFrame:
    """C4 for one partition (a tenant already filtered): ordered top-k with offset."""
    return df.orderBy(*order).offset(page.offset).limit(page.limit)


def totals(df: DataFrame, partition: list[str], name: str = "total") -> DataFrame:
    return df.groupBy(*partition).agg(F.count(F.lit(1)).alias(name))


def paged_with_total(df: DataFrame, partition: list[str], order: list[Column], page: Page) -> DataFrame:
    """``paged`` with each partition's ``total``. A partition whose page is
    empty keeps one row with its total, ``position`` and the rest null. Pages
    that end beyond ``DEEP`` rows are found by order statistics."""
    if page.offset + page.limit > DEEP:
        return deep_page_with_total(df, partition, order, page)
    return totals(df, partition).join(paged(df, partition, order, page), partition, "left")


def deep_page_with_total(df: DataFrame, partition: list[str], order: list[Column], page: Page,
                         ranges: int | None = None) -> DataFrame:
    """``paged_with_total`` for pages far down a large partition, without sorting
    a partition in one task. Rows are cut into ``ranges`` (default: the session's
    shuffle partitions) by sampled bounds of (partition, order) and written once,
    unsorted. The counts per partition and range say how many rows precede each
    range; only ranges that overlap the page are read again and sorted, each
    on its own. No partition has more than ``ranges`` counts."""
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = materialize(df.repartitionByRange(ranges, *partition, *order)
                      .withColumn("__range", F.spark_partition_id()), f"page_ranges_{uuid.uuid4().hex}")
    counts = cut.groupBy(*partition, "__range").agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy(*partition).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0)))
    wanted = counts.where((F.col("__before") < page.offset + page.limit)
                          & (F.col("__before") + F.col("__rows") > page.offset)).drop("__rows")
    # null-safe on the partition: it may hold nulls, as a window's may
    named = wanted.select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(partition)),
                          F.col("__range").alias("__at"), "__before")
    match = F.col("__range") == F.col("__at")
    for i, c in enumerate(partition):
        match = match & F.col(c).eqNullSafe(F.col(f"__{i}"))
    nth = F.row_number().over(Window.partitionBy(*partition, "__range").orderBy(*order))
    rows = (cut.join(bounded_broadcast(named), match)
            .withColumn("position", (F.col("__before") + nth).cast("long"))
            .where((F.col("position") > page.offset) & (F.col("position") <= page.offset + page.limit))
            .select(*df.columns, "position"))
    total = counts.groupBy(*partition).agg(F.sum("__rows").alias("total"))
    return total.join(rows, partition, "left")


def newest_first() -> list[Column]:
    """``created_at desc`` with ``id`` as tie-break, so pages are deterministic."""
    return [F.col("created_at").desc(), F.col("id").desc()]


def oldest_first() -> list[Column]:
    return [F.col("created_at").asc(), F.col("id").asc()]


# ------------------------------------------------------------------ meters
def meter_counts(meters: DataFrame, by: tuple[str, ...] = ("tenant_slug",)) -> DataFrame:
    """Meters per tenant, or per (tenant, event_type)."""
    return meters.groupBy(*by).agg(F.count(F.lit(1)).alias("meters"))


def value_properties(meters: DataFrame, tenant: str | None = None, event_type: str | None = None) -> DataFrame:
    """Distinct non-null value properties per tenant and event type, sorted."""
    df = _given(meters, tenant_slug=tenant, event_type=event_type)
    return (df.where(F.col("value_property").isNotNull())
            .select("tenant_slug", "event_type", "value_property").distinct()
            .orderBy("tenant_slug", "event_type", "value_property"))


def event_properties(meters: DataFrame, tenant: str | None = None, event_type: str | None = None) -> DataFrame:
    """Distinct unnested properties per tenant and event type, sorted."""
    df = _given(meters, tenant_slug=tenant, event_type=event_type)
    return (df.select("tenant_slug", "event_type", F.explode("properties").alias("property")).distinct()
            .orderBy("tenant_slug", "event_type", "property"))


def meters_page(meters: DataFrame, page: Page = Page(), tenant: str | None = None) -> DataFrame:
    """C4: newest meters first, one page per tenant, with the total."""
    return paged_with_total(_given(meters, tenant_slug=tenant), ["tenant_slug"], newest_first(), page)


# ------------------------------------------------------- plans / features
def plans_page(plans: DataFrame, page: Page = Page(), tenant: str | None = None,
               plan_type: str | None = None, archived: bool | None = None) -> DataFrame:
    """Plans of a tenant, optional type and archived flag, with the total.

    The total counts the same rows as the page (the reference's count ignores
    the archived flag; documented divergence)."""
    df = _given(plans, tenant_slug=tenant, type=plan_type)
    if archived is not None:
        df = df.where(F.col("archived_at").isNotNull() == F.lit(archived))
    return paged_with_total(df, ["tenant_slug"], newest_first(), page)


def features_page(features: DataFrame, page: Page = Page(), tenant: str | None = None,
                  feature_type: str | None = None) -> DataFrame:
    """Features of a tenant, optional type, with the total."""
    df = _given(features, tenant_slug=tenant, type=feature_type)
    return paged_with_total(df, ["tenant_slug"], newest_first(), page)


def plan_features_listing(plan_features: DataFrame, features: DataFrame, plans: DataFrame,
                          plan_id: str | None = None, tenant: str | None = None,
                          feature_type: str | None = None) -> DataFrame:
    """Plan-features joined with their feature and plan, newest first."""
    f = features.select(
        F.col("id").alias("__fid"), F.col("name").alias("feature_name"), F.col("slug").alias("feature_slug"),
        F.col("type").alias("feature_type"), F.col("config").alias("feature_config"))
    p = _given(plans, id=plan_id, tenant_slug=tenant).select(F.col("id").alias("__pid"), "tenant_slug")
    if feature_type is not None:
        f = f.where(F.col("feature_type") == F.lit(feature_type))
    pf = _given(plan_features, plan_id=plan_id)
    out = (pf.join(bounded_broadcast(f), pf["feature_id"] == f["__fid"])
           .join(bounded_broadcast(p), pf["plan_id"] == p["__pid"])
           .select(F.col("id").alias("plan_feature_id"), "plan_id", "feature_id", "config", "created_at",
                   "feature_name", "feature_slug", "feature_type", "feature_config", "tenant_slug"))
    # the config text read as JSON; text that is none gives null
    out = out.withColumn("config_json", F.try_parse_json("config"))
    return out.orderBy(F.col("created_at").desc(), F.col("plan_feature_id").desc())


def tenant_link_check(requests: DataFrame, plans: DataFrame, features: DataFrame) -> DataFrame:
    """A request (plan_id, feature_id, tenant_slug) is allowed when the
    plan is the tenant's and the feature belongs to the same tenant.
    Adds boolean ``allowed``."""
    p = plans.select(F.col("id").alias("__pid"), F.col("tenant_slug").alias("__pt"))
    f = features.select(F.col("id").alias("__fid"), F.col("tenant_slug").alias("__ft"))
    joined = (requests.join(bounded_broadcast(p), requests["plan_id"] == p["__pid"], "left")
              .join(bounded_broadcast(f), requests["feature_id"] == f["__fid"], "left"))
    allowed = F.coalesce((F.col("__pt") == F.col("tenant_slug")) & (F.col("__ft") == F.col("__pt")), F.lit(False))
    return joined.select(*requests.columns, allowed.alias("allowed"))


def plan_feature_ids(requests: DataFrame, plan_features: DataFrame, plans: DataFrame,
                     features: DataFrame) -> DataFrame:
    """Resolve (plan_id, feature_id, tenant_slug) to plan_feature_id."""
    p = plans.select(F.col("id").alias("__pid"), F.col("tenant_slug").alias("__pt"))
    f = features.select(F.col("id").alias("__fid"))
    pf = plan_features.select(F.col("id").alias("plan_feature_id"),
                              F.col("plan_id").alias("__pfp"), F.col("feature_id").alias("__pff"))
    return (requests
            .join(pf, (requests["plan_id"] == pf["__pfp"]) & (requests["feature_id"] == pf["__pff"]))
            .join(bounded_broadcast(p), (F.col("plan_id") == p["__pid"]) & (F.col("tenant_slug") == p["__pt"]))
            .join(bounded_broadcast(f), F.col("feature_id") == f["__fid"])
            .select(*requests.columns, "plan_feature_id"))


def metered_plan_features(plan_features: DataFrame, features: DataFrame) -> DataFrame:
    metered = features.where(F.col("type") == "metered").select(F.col("id").alias("__fid"))
    return plan_features.join(bounded_broadcast(metered), plan_features["feature_id"] == metered["__fid"],
                              "left_semi")


def unmetered_quotas(quotas: DataFrame, plan_features: DataFrame, features: DataFrame) -> DataFrame:
    """C11: quotas whose plan-feature is not a metered feature."""
    ok = metered_plan_features(plan_features, features).select(F.col("id").alias("__pfid"))
    return quotas.join(ok, quotas["plan_feature_id"] == ok["__pfid"], "left_anti")


def entitlements(plan_features: DataFrame, features: DataFrame, plans: DataFrame,
                 quotas: DataFrame) -> DataFrame:
    """Every plan-feature with its plan, feature and quota (if any)."""
    q = quotas.select(F.col("plan_feature_id").alias("__pfid"), "limit_value", "reset_period",
                      "custom_period_minutes", "action_at_limit")
    listing = plan_features_listing(plan_features, features, plans)
    return (listing.join(q, listing["plan_feature_id"] == q["__pfid"], "left")
            .select("tenant_slug", "plan_id", "feature_id", "plan_feature_id", "feature_type",
                    "limit_value", "reset_period", "custom_period_minutes", "action_at_limit"))


def quota_violations(quotas: DataFrame) -> DataFrame:
    """One row per (quota, broken rule).

    Rules: custom period needs minutes, other periods forbid them; limit > 0;
    period and action in their allowed sets; one quota per plan-feature.
    Duplicates are found by a partial-aggregated count per plan-feature
    joined back (no per-key buffering of a hot plan-feature).
    """
    dup = (quotas.groupBy("plan_feature_id").agg(F.count(F.lit(1)).alias("__n"))
           .where(F.col("__n") > 1).select(F.col("plan_feature_id").alias("__dpf"), F.lit(True).alias("__dup")))
    df = quotas.join(dup, quotas["plan_feature_id"] == dup["__dpf"], "left")
    period, minutes = F.col("reset_period"), F.col("custom_period_minutes")
    rules = F.array(
        F.when((period == "custom") & minutes.isNull(), F.lit("custom_without_minutes")),
        F.when((period != "custom") & minutes.isNotNull(), F.lit("minutes_without_custom")),
        F.when(minutes.isNotNull() & (minutes <= 0), F.lit("non_positive_minutes")),
        F.when(F.col("limit_value") <= 0, F.lit("non_positive_limit")),
        F.when(~period.isin(*RESET_PERIODS), F.lit("unknown_reset_period")),
        F.when(~F.col("action_at_limit").isin(*LIMIT_ACTIONS), F.lit("unknown_action")),
        F.when(F.col("__dup"), F.lit("duplicate_plan_feature")),
    )
    return (df.select("id", "plan_feature_id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("violation")))


# ------------------------------------------------------------- assignments
def _upper_bound_le(col: str, bound: dt.datetime) -> Column:
    """``col <= bound`` where an open end (NULL) stands for the reference's
    zero-time sentinel, which is below every bound (F20)."""
    return F.col(col).isNull() | (F.col(col) <= F.lit(bound))


def _upper_bound_lt(col: str, bound: dt.datetime) -> Column:
    return F.col(col).isNull() | (F.col(col) < F.lit(bound))


def _with_tenant(df: DataFrame, plans: DataFrame, tenant: str | None) -> DataFrame:
    """EXISTS (plan in tenant) as a join that also carries the tenant."""
    p = _given(plans, tenant_slug=tenant).select(F.col("id").alias("__pid"), "tenant_slug")
    return df.join(bounded_broadcast(p), df["plan_id"] == p["__pid"]).drop("__pid")


def assignments_page(assignments: DataFrame, plans: DataFrame, page: Page = Page(),
                     tenant: str | None = None, organization_id: str | None = None,
                     user_id: str | None = None, plan_id: str | None = None,
                     valid_from_gte: dt.datetime | None = None,
                     valid_until_lte: dt.datetime | None = None) -> DataFrame:
    """C14: filtered assignments of a tenant's plans, newest first, with total."""
    df = _given(assignments, organization_id=organization_id, user_id=user_id, plan_id=plan_id)
    if valid_from_gte is not None:
        df = df.where(F.col("valid_from") >= F.lit(valid_from_gte))
    if valid_until_lte is not None:
        df = df.where(_upper_bound_le("valid_until", valid_until_lte))
    df = _with_tenant(df, plans, tenant)
    return paged_with_total(df, ["tenant_slug"], newest_first(), page)


def assignments_of(assignments: DataFrame, plans: DataFrame, tenant: str | None = None,
                   organization_id: str | None = None, user_id: str | None = None,
                   plan_id: str | None = None) -> DataFrame:
    """C14 without paging: every matching assignment with its tenant."""
    df = _given(assignments, organization_id=organization_id, user_id=user_id, plan_id=plan_id)
    return _with_tenant(df, plans, tenant)


def active_assignments_page(assignments: DataFrame, plans: DataFrame, page: Page = Page(),
                            tenant: str | None = None) -> DataFrame:
    """Assignments of the tenant's non-archived plans, newest first."""
    live = plans.where(F.col("archived_at").isNull())
    df = _with_tenant(assignments, live, tenant)
    return paged_with_total(df, ["tenant_slug"], newest_first(), page)


def history_page(history: DataFrame, plans: DataFrame, page: Page = Page(), tenant: str | None = None,
                 organization_id: str | None = None, user_id: str | None = None,
                 plan_id: str | None = None, action: str | None = None,
                 valid_from_before: dt.datetime | None = None, valid_from_after: dt.datetime | None = None,
                 valid_until_before: dt.datetime | None = None,
                 valid_until_after: dt.datetime | None = None) -> DataFrame:
    """Assignment history, half-open bounds, oldest first, with total."""
    df = _given(history, organization_id=organization_id, user_id=user_id, plan_id=plan_id, action=action)
    if valid_from_before is not None:
        df = df.where(F.col("valid_from") < F.lit(valid_from_before))
    if valid_from_after is not None:
        df = df.where(F.col("valid_from") >= F.lit(valid_from_after))
    if valid_until_before is not None:
        df = df.where(_upper_bound_lt("valid_until", valid_until_before))
    if valid_until_after is not None:
        df = df.where(F.col("valid_until") >= F.lit(valid_until_after))
    df = _with_tenant(df, plans, tenant)
    return paged_with_total(df, ["tenant_slug"], oldest_first(), page)


def archived_plan_rejects(requests: DataFrame, plans: DataFrame) -> DataFrame:
    """C20: assignment requests naming an archived plan (reason column)."""
    archived = plans.where(F.col("archived_at").isNotNull()).select(F.col("id").alias("__pid"))
    return (requests.join(bounded_broadcast(archived), requests["plan_id"] == archived["__pid"], "left_semi")
            .withColumn("reason", F.lit("plan_archived")))


def assignment_violations(assignments: DataFrame) -> DataFrame:
    """One row per (assignment, broken rule): exactly one of
    organization/user; valid_from <= valid_until unless open-ended; unique
    (plan, organization) and (plan, user)."""
    org_dup = (assignments.where(F.col("organization_id").isNotNull())
               .groupBy("plan_id", "organization_id").agg(F.count(F.lit(1)).alias("__n"))
               .where("__n > 1").select(F.col("plan_id").alias("__p1"), F.col("organization_id").alias("__o"),
                                        F.lit(True).alias("__dup_org")))
    user_dup = (assignments.where(F.col("user_id").isNotNull())
                .groupBy("plan_id", "user_id").agg(F.count(F.lit(1)).alias("__n"))
                .where("__n > 1").select(F.col("plan_id").alias("__p2"), F.col("user_id").alias("__u"),
                                         F.lit(True).alias("__dup_user")))
    df = (assignments
          .join(org_dup, (assignments["plan_id"] == org_dup["__p1"])
                & (assignments["organization_id"] == org_dup["__o"]), "left")
          .join(user_dup, (assignments["plan_id"] == user_dup["__p2"])
                & (assignments["user_id"] == user_dup["__u"]), "left"))
    has_org, has_user = F.col("organization_id").isNotNull(), F.col("user_id").isNotNull()
    rules = F.array(
        F.when(has_org == has_user, F.lit("not_exactly_one_entity")),
        F.when(F.col("valid_until").isNotNull() & (F.col("valid_from") > F.col("valid_until")),
               F.lit("valid_from_after_valid_until")),
        F.when(F.col("__dup_org"), F.lit("duplicate_plan_organization")),
        F.when(F.col("__dup_user"), F.lit("duplicate_plan_user")),
    )
    return df.select("id", "plan_id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("violation"))


def cascade_delete(plans: DataFrame, features: DataFrame, plan_features: DataFrame, quotas: DataFrame,
                   assignments: DataFrame, deleted_plans: DataFrame | None = None,
                   deleted_features: DataFrame | None = None) -> DataFrame:
    """Rows removed by deleting plans and/or features (``id`` columns),
    following the reference's ON DELETE CASCADE chain, plus rows that are
    already orphaned. Output ``(entity, id)``.

    plan -> plan_feature -> quota; feature -> plan_feature -> quota;
    plan -> assignment. Every step is a left-anti / left-semi join.
    """
    def gone_ids(deleted: DataFrame | None) -> DataFrame | None:
        return None if deleted is None else deleted.select(F.col("id").alias("__gone")).distinct()

    def lost(df: DataFrame, key: str, owners: DataFrame, removed: DataFrame | None) -> DataFrame:
        """``df`` with ``__has_{key}``: true if the row's owner is there and stays, else null."""
        here = owners.select(F.col("id").alias(f"__{key}"), F.lit(True).alias(f"__has_{key}"))
        if removed is not None:
            here = here.join(removed, here[f"__{key}"] == removed["__gone"], "left_anti")
        return df.join(bounded_broadcast(here), df[key] == here[f"__{key}"], "left")

    gone_plans, gone_features = gone_ids(deleted_plans), gone_ids(deleted_features)
    pf = lost(plan_features.select("id", "plan_id", "feature_id"), "plan_id", plans, gone_plans)
    pf = lost(pf, "feature_id", features, gone_features)
    # one table of plan-features with whether they stay; quotas follow it
    pf = pf.select("id", (F.col("__has_plan_id").isNotNull() & F.col("__has_feature_id").isNotNull()).alias("stays"))
    pf_gone = pf.where("not stays")
    kept = pf.where("stays").select(F.col("id").alias("__k"))
    q_gone = quotas.join(kept, quotas["plan_feature_id"] == kept["__k"], "left_anti")
    a_gone = lost(assignments.select("id", "plan_id"), "plan_id", plans, gone_plans).where("__has_plan_id is null")

    def named(df: DataFrame, removed: DataFrame | None) -> DataFrame:
        return df.limit(0) if removed is None else df.join(removed, df["id"] == removed["__gone"], "left_semi")

    parts = [
        named(plans, gone_plans).select(F.lit("plan").alias("entity"), "id"),
        named(features, gone_features).select(F.lit("feature").alias("entity"), "id"),
        pf_gone.select(F.lit("plan_feature").alias("entity"), "id"),
        q_gone.select(F.lit("quota").alias("entity"), "id"),
        a_gone.select(F.lit("assignment").alias("entity"), "id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
