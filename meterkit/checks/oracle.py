"""DuckDB texts of the fixture views, used only by oracle SQL.

They restate ``meterkit.sources.fixtures`` and ``meterkit.sources.catalog``
in DuckDB SQL so every registered Spark query has an independent twin over
the same parquet tables (pre-registered as views by the checker).
"""

from __future__ import annotations

K = "json_extract_string(props, '$.k')"

USAGE_EVENTS = f"""usage_events as (
  select concat('evt_', cast(event_id as varchar)) as id,
         concat('app.', event_type) as type,
         case when event_id % 2 = 0 then 'web_api' else 'mobile_api' end as source,
         concat('org_', cast(user_id % 10 as varchar)) as organization,
         concat('usr_', cast(user_id as varchar)) as "user",
         date_trunc('second', ts) as "timestamp",
         concat('{{"k":"k', {K}, '","page":"p', cast(cast({K} as integer) % 10 as varchar),
                '","amount":', cast(value as varchar), '}}') as properties
  from events)"""

# Metered view of usage_events: dimensions and value read like JSONExtractString.
METERED = """metered as (
  select *, date_trunc('minute', "timestamp") as ws,
         date_trunc('minute', "timestamp") + interval 1 minute as we,
         coalesce(json_extract_string(properties, '$.page'), '') as page,
         coalesce(json_extract_string(properties, '$.k'), '') as k,
         try_cast(json_extract_string(properties, '$.amount') as double) as amount
  from usage_events)"""


def with_views(body: str, *views: str) -> str:
    return "with " + ",\n".join(views) + "\n" + body

# Expected validation outcome per event_id % 50 (FIXTURES B7), as SQL.
DIRTY_REASON = """case event_id % 50
    when 7 then 'missing_event_type'
    when 11 then 'missing_meter'
    when 13 then 'invalid_properties'
    when 15 then 'invalid_properties'
    when 17 then 'missing_properties'
    when 19 then 'missing_properties'
    when 23 then 'missing_properties'
    when 29 then 'missing_properties'
    when 31 then 'missing_properties'
    when 33 then 'missing_properties'
    when 37 then 'missing_properties'
    when 39 then 'missing_properties'
    when 43 then 'invalid_timestamp'
    when 47 then 'invalid_field'
  end"""

DIRTY_MISSING = """case event_id % 50
    when 17 then 'amount'
    when 19 then 'amount'
    when 23 then 'k'
    when 29 then 'page'
    when 31 then 'amount,k,page'
    when 33 then 'amount,k,page'
    when 37 then 'amount,k,page'
    when 39 then 'page'
  end"""

# Accepted events of the dirty fixture in stored form.
DIRTY_ACCEPTED = f"""accepted as (
  select concat('evt_', cast(event_id as varchar)) as id,
         concat('app.', event_type) as type,
         case when event_id % 2 = 0 then 'web_api' else 'mobile_api' end as source,
         concat('org_', cast(user_id % 10 as varchar)) as organization,
         concat('usr_', cast(user_id as varchar)) as "user",
         date_trunc('second', ts) as "timestamp",
         concat('{{"k":"k', {K}, '","page":',
                case when event_id % 100 = 95 then '"[]"'
                     else concat('"p', cast(cast({K} as integer) % 10 as varchar), '"') end,
                ',"amount":',
                case when event_id % 50 = 41 then '"abc"'
                     when event_id % 100 = 45 then '0'
                     else cast(value as varchar) end,
                '}}') as properties,
         event_id, value
  from events
  where ({DIRTY_REASON}) is null)"""


def case_of(index_sql: str, values: tuple[str, ...]) -> str:
    whens = " ".join(f"when {i} then '{v}'" for i, v in enumerate(values))
    return f"case {index_sql} {whens} end"


# Reset periods, actions and aggregations in fixture order.
_PERIODS = ("day", "week", "month", "year", "custom", "rolling", "never")
_ACTIONS = ("none", "block", "throttle")
_AGGS = ("count", "sum", "avg", "min", "max", "unique_count")

TENANTS = """tenants as (select r_regionkey, lower(replace(r_name, ' ', '_')) as tenant_slug from region)"""

METERS = f"""meters_t as (
  select concat('mtr_', cast(p_partkey as varchar)) as id, concat('m', cast(p_partkey as varchar)) as slug,
         p_name as name, concat(split_part(p_name, ' ', 2), '.', lower(p_type)) as event_type,
         case when p_size % 6 = 0 then null when p_partkey % 3 = 0 then 'amount'
              when p_partkey % 3 = 1 then 'tokens' else 'latency_ms' end as value_property,
         case when p_size > 25 then [split_part(p_name, ' ', 1), 'region'] else [split_part(p_name, ' ', 1)] end
           as properties,
         {case_of('p_size % 6', _AGGS)} as aggregation,
         tenant_slug, timestamp '2024-01-01' + to_seconds(p_partkey) as created_at
  from part join tenants on p_partkey % 5 = r_regionkey)"""

PLANS = """plans_t as (
  select concat('plan_', cast(n_nationkey as varchar)) as id, lower(replace(n_name, ' ', '_')) as slug,
         n_name as name, case when n_nationkey % 3 = 0 then 'custom' else 'standard' end as type, tenant_slug,
         timestamp '2024-01-01' + to_days(n_nationkey) as created_at,
         case when n_nationkey % 5 = 0 then timestamp '2024-01-01' + to_days(n_nationkey + 100) end as archived_at
  from nation join tenants on n_regionkey = r_regionkey)"""

FEATURES = """features_t as (
  select concat(p_brand, '@', tenant_slug) as id,
         concat('f', cast(b as varchar), '_', cast(r_regionkey as varchar)) as slug, p_brand as name,
         case when b % 2 = 1 then 'metered' else 'static' end as type,
         case when b % 2 = 1 then '{"unit":"call"}' else '{}' end as config, tenant_slug,
         timestamp '2024-01-01' + to_seconds((b * 5 + r_regionkey) * 60) as created_at
  from (select distinct p_brand, cast(substr(p_brand, 7) as integer) as b, r_regionkey, tenant_slug
        from part join tenants on p_partkey % 5 = r_regionkey))"""

LINKS = """links_t as (
  select concat('plan_', cast(l.n as varchar)) as plan_id, concat(l.p_brand, '@', ft.tenant_slug) as feature_id,
         pt.tenant_slug as tenant_slug, l.n, l.b, l.fr, pt.tenant_slug = ft.tenant_slug as same_tenant
  from (select distinct s_nationkey as n, p_brand, cast(substr(p_brand, 7) as integer) as b, p_partkey % 5 as fr
        from lineitem join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey) l
  join (select n_nationkey, tenant_slug from nation join tenants on n_regionkey = r_regionkey) pt
    on pt.n_nationkey = l.n
  join tenants ft on ft.r_regionkey = l.fr)"""

PLAN_FEATURES = """plan_features_t as (
  select concat(plan_id, ':', feature_id) as id, plan_id, feature_id,
         case when b % 4 = 0 then '{"visible":true}' end as config,
         timestamp '2024-01-01' + to_seconds((n * 1000 + b * 5 + fr) * 60) as created_at
  from links_t where same_tenant)"""

QUOTAS = f"""quota_base as (
  select concat('q_', plan_id, ':', feature_id) as id, concat(plan_id, ':', feature_id) as plan_feature_id,
         cast(case when (n + b) % 17 = 0 then 0 else b * 1000 end as bigint) as limit_value,
         {case_of('(n + b) % 7', _PERIODS)} as reset_period,
         n, b, {case_of('b % 3', _ACTIONS)} as action_at_limit,
         timestamp '2024-01-01' + to_seconds((n * 1000 + b * 5 + fr) * 60 + 1) as created_at
  from links_t where same_tenant and (b % 2 = 1 or (n + b) % 7 = 0)),
quota_one as (
  select id, plan_feature_id, limit_value, reset_period,
         case when reset_period = 'custom' and (n * b) % 11 <> 0 then cast(b * 60 as bigint)
              when reset_period <> 'custom' and (n * b) % 13 = 0 then cast(30 as bigint) end
           as custom_period_minutes,
         action_at_limit, created_at, (n * b) % 19 = 0 as dup
  from quota_base),
quotas_t as (
  select id, plan_feature_id, limit_value, reset_period, custom_period_minutes, action_at_limit, created_at
  from quota_one
  union all
  select concat('q2_', plan_feature_id), plan_feature_id, limit_value, reset_period, custom_period_minutes,
         action_at_limit, created_at + interval 1 second
  from quota_one where dup)"""

ASSIGNMENTS = """assignments_t as (
  select concat('asg_', cast(c_custkey as varchar)) as id, concat('plan_', cast(c_nationkey as varchar)) as plan_id,
         case when c_custkey % 2 = 0 then concat('org_', cast(c_custkey as varchar)) end as organization_id,
         case when c_custkey % 2 = 1 then concat('usr_', cast(c_custkey as varchar)) end as user_id,
         timestamp '2024-01-01' + to_days(cast(c_custkey % 365 as integer)) as valid_from,
         case when c_custkey % 7 <> 0
              then timestamp '2024-01-01' + to_days(cast(c_custkey % 365 + 90 as integer)) end as valid_until,
         timestamp '2024-01-01' + to_seconds(c_custkey) as created_at
  from customer)"""

HISTORY = """history_t as (
  select concat('h_', cast(o_orderkey as varchar)) as id,
         case o_orderstatus when 'O' then 'CREATE' when 'P' then 'UPDATE' else 'DELETE' end as action,
         concat('asg_', cast(c_custkey as varchar)) as assignment_id,
         concat('plan_', cast(c_nationkey as varchar)) as plan_id,
         case when c_custkey % 2 = 0 then concat('org_', cast(c_custkey as varchar)) end as organization_id,
         case when c_custkey % 2 = 1 then concat('usr_', cast(c_custkey as varchar)) end as user_id,
         o_orderdate as valid_from,
         case when o_orderkey % 7 <> 0 then o_orderdate + interval 90 day end as valid_until,
         o_orderdate + to_seconds(o_orderkey % 86400) as created_at
  from orders join customer on o_custkey = c_custkey)"""

CHANGES = """changes_a as (
  select o_orderkey, c_custkey, c_nationkey, o_orderdate,
         case when o_orderstatus = 'P' then 'CREATE'
              when o_orderstatus = 'F' and o_orderkey % 5 = 0 then 'DELETE' else 'UPDATE' end as action
  from orders join customer on o_custkey = c_custkey),
changes_t as (
  select concat('chg_', cast(o_orderkey as varchar)) as change_id, o_orderkey as seq, action,
         concat('plan_', cast(case when o_orderkey % 9 = 0 then (c_nationkey + 1) % 25 else c_nationkey end
                              as varchar)) as plan_id,
         case when c_custkey % 2 = 0 or o_orderkey % 97 = 0 then concat('org_', cast(c_custkey as varchar)) end
           as organization_id,
         case when c_custkey % 2 = 1 or o_orderkey % 97 = 0 then concat('usr_', cast(c_custkey as varchar)) end
           as user_id,
         case when action = 'CREATE' then timestamp '2024-01-01' + to_seconds((o_orderkey % 365) * 86400)
              when action = 'UPDATE' and o_orderkey % 3 <> 0
              then timestamp '2024-01-01' + to_seconds((c_custkey % 365 + o_orderkey % 120 - 20) * 86400)
         end as valid_from,
         case when action = 'CREATE' then
                case when o_orderkey % 11 = 0
                     then timestamp '2024-01-01' + to_seconds((o_orderkey % 365) * 86400 - 86400)
                     when o_orderkey % 7 <> 0
                     then timestamp '2024-01-01' + to_seconds((o_orderkey % 365) * 86400 + 30 * 86400) end
              when action = 'UPDATE' and o_orderkey % 4 <> 0
              then timestamp '2024-01-01' + to_seconds((c_custkey % 365 + 30 + o_orderkey % 90) * 86400)
         end as valid_until,
         action = 'UPDATE' and o_orderkey % 13 = 0 as clear_valid_until,
         o_orderdate + to_seconds(o_orderkey % 86400) as requested_at
  from changes_a)"""

# Sequential application of the changes, one step per change rank, all keys
# in parallel (recursive CTE): the independent twin of the Spark fold.
CHANGE_WALK = """checked_k as (
  select c.*, cast(json_array(c.plan_id, c.organization_id, c.user_id) as varchar) as key,
         case when c.action = 'CREATE' and c.valid_from is null then 'missing_valid_from'
              when c.action = 'CREATE' and c.valid_until is not null and c.valid_from > c.valid_until
                then 'valid_from_after_valid_until'
              when (c.organization_id is not null) = (c.user_id is not null)
                then 'not_exactly_one_entity'
              when c.action = 'CREATE' and p.id is null then 'unknown_plan'
              when c.action = 'CREATE' and p.archived_at is not null then 'plan_archived' end as pre_reason
  from changes_t c left join plans_t p on c.plan_id = p.id),
checked as (
  select *, row_number() over (partition by key order by requested_at, seq) as rn from checked_k),
a_keyed as (
  select *, cast(json_array(plan_id, organization_id, user_id) as varchar) as key
  from assignments_t),
all_keys as (select key from checked union select key from a_keyed),
walk as (
  select k.key, 0 as rn, a.id is not null as ex, a.id as aid,
         a.plan_id as pid, a.organization_id as oid, a.user_id as uid,
         a.valid_from as vf, a.valid_until as vu, a.created_at as ca, a.created_at as ua,
         cast(null as varchar) as change_id, cast(null as varchar) as action, cast(null as varchar) as outcome,
         cast(null as varchar) as reason,
         cast(null as varchar) as h_aid, cast(null as timestamp) as h_vf, cast(null as timestamp) as h_vu,
         cast(null as timestamp) as h_at,
         cast(null as varchar) as h_pid, cast(null as varchar) as h_oid, cast(null as varchar) as h_uid
  from all_keys k left join a_keyed a on a.key = k.key
  union all
  select key, rn,
         case when r is not null then ex when action = 'CREATE' then true when action = 'DELETE' then false
              else ex end,
         case when r is null and action = 'CREATE' then concat('asg_', change_id)
              when r is null and action = 'DELETE' then null else aid end,
         case when r is null and action = 'CREATE' then c_pid when r is null and action = 'DELETE' then null
              else pid end,
         case when r is null and action = 'CREATE' then c_oid when r is null and action = 'DELETE' then null
              else oid end,
         case when r is null and action = 'CREATE' then c_uid when r is null and action = 'DELETE' then null
              else uid end,
         case when r is null and action = 'CREATE' then c_vf
              when r is null and action = 'UPDATE' then coalesce(c_vf, vf)
              when r is null and action = 'DELETE' then null else vf end,
         case when r is null and action = 'CREATE' then c_vu
              when r is null and action = 'UPDATE'
                then case when c_vu is not null then c_vu when c_clear then null else vu end
              when r is null and action = 'DELETE' then null else vu end,
         case when r is null and action = 'CREATE' then c_at when r is null and action = 'DELETE' then null
              else ca end,
         case when r is null and action in ('CREATE', 'UPDATE') then c_at
              when r is null and action = 'DELETE' then null else ua end,
         change_id, action,
         case when r is not null then 'rejected' when action = 'DELETE' and not ex then 'no_op'
              else 'applied' end,
         r,
         case when r is null and action = 'CREATE' then concat('asg_', change_id)
              when r is null and ex then aid end,
         case when r is null and action = 'CREATE' then c_vf
              when r is null and action = 'UPDATE' and ex then coalesce(c_vf, vf)
              when r is null and action = 'DELETE' and ex then vf end,
         case when r is null and action = 'CREATE' then c_vu
              when r is null and action = 'UPDATE' and ex
                then case when c_vu is not null then c_vu when c_clear then null else vu end
              when r is null and action = 'DELETE' and ex then vu end,
         c_at, c_pid, c_oid, c_uid
  from (
    select w.key, c.rn, w.ex, w.aid, w.pid, w.oid, w.uid, w.vf, w.vu, w.ca, w.ua,
           c.change_id, c.action, c.plan_id as c_pid, c.organization_id as c_oid, c.user_id as c_uid,
           c.valid_from as c_vf, c.valid_until as c_vu, c.clear_valid_until as c_clear, c.requested_at as c_at,
           case when c.pre_reason is not null then c.pre_reason
                when c.action = 'CREATE' and w.ex then 'already_assigned'
                when c.action = 'UPDATE' and not w.ex then 'not_found'
                when c.action = 'UPDATE' and c.valid_from is not null and c.valid_from < w.vf
                  then 'valid_from_before_current'
                when c.action = 'UPDATE' and c.valid_from is not null and w.vu is not null and c.valid_from > w.vu
                  then 'valid_from_after_current_until'
                when c.action = 'UPDATE' and c.valid_until is not null and w.vu is not null
                     and c.valid_until > w.vu
                  then 'valid_until_after_current'
           end as r
    from walk w join checked c on c.key = w.key and c.rn = w.rn + 1) step)"""


# Keys that differ only in where a separator stands: customers 2j and 2j + 1
# hold (p, org k|j) and (p|k, org j).
def with_separators(view: str, number: str) -> str:
    return f"""{view} as (
  select * replace (
    case when {number} % 2 = 0 then 'p' else 'p|k' end as plan_id,
    concat(case when {number} % 2 = 0 then 'k|' else '' end, cast({number} // 2 as varchar)) as organization_id,
    cast(null as varchar) as user_id)
  from {view}_plain)"""


SEPARATOR_VIEWS = (
    """plans_t as (
  select unnest(['p', 'p|k']) as id, cast(null as timestamp) as archived_at)""",
    ASSIGNMENTS.replace("assignments_t as", "assignments_t_plain as", 1),
    with_separators("assignments_t", "cast(id[5:] as bigint)"),
    CHANGES.replace("changes_t as", "changes_t_plain as", 1),
    with_separators("changes_t", "cast(coalesce(organization_id, user_id)[5:] as bigint)"))

# Every tenth assignment has a younger double under the same key.
DOUBLED_VIEWS = (
    ASSIGNMENTS.replace("assignments_t as", "assignments_plain as", 1),
    """older as (select * from assignments_plain where cast(id[5:] as bigint) % 10 = 0)""",
    """assignments_t as (
  select * from assignments_plain where cast(id[5:] as bigint) % 10 <> 0
  union all
  select * replace (concat('dup_', id[5:]) as id, created_at + interval 1 second as created_at) from older)""",
    CHANGES)

# Texts a numeric meter meets, by event_id % 12, and what they measure.
VALUE_TEXTS = {0: ("12d", None), 1: ("1f", None), 2: ("0x1p3", None), 3: (" 7 ", None), 4: ("NaN", None),
               5: ("Infinity", None), 6: ("", None), 7: ("1e2", 100.0), 8: ("-3.5", -3.5), 9: ("+4", 4.0), 10: (".5", 0.5)}
