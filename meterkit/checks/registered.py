"""Registered queries: one per inventory operator that yields a table.

Every entry reads the whole driver tables under ``sf_dir`` (through the
fixture views) and has, where SQL can state it, a DuckDB twin written from
the reference's semantics rather than from the Spark code. Sums and averages
are rounded on both sides, for summation order differs by engine.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterkit.checks.oracle import (
    ASSIGNMENTS, CHANGE_WALK, CHANGES, DIRTY_ACCEPTED, DIRTY_MISSING, DIRTY_REASON, DOUBLED_VIEWS, FEATURES, HISTORY,
    LINKS, METERED, METERS, PLAN_FEATURES, PLANS, QUOTAS, SEPARATOR_VIEWS, TENANTS, USAGE_EVENTS, VALUE_TEXTS,
    with_views)
from meterkit.operators import catalog as cat
from meterkit.operators import changes as chg
from meterkit.operators import ingest
from meterkit.operators.bitmaps import add_values, bitmap_partials, merge_bitmaps, query_bitmaps
from meterkit.operators.multi import long_partials
from meterkit.operators.tiers import build_tier, query_tiers
from meterkit.operators.query import query_events, query_rollup, result_range, shape_rows
from meterkit.operators.rollup import VALUE, compact_partials, extract, minute_partials, rollup_rejects
from meterkit.plans.spec import MeterQuery, MeterSpec
from meterkit.session import materialize, scratch_path
from meterkit.sources import catalog as fx
from meterkit.sources import rollup_store as store
from meterkit.sources.catalog_io import read_catalog
from meterkit.sources.events import fold_events, read_events
from meterkit.sources.fixtures import dirty_meters, dirty_raw_events, usage_events
from meterkit.streaming.ingest import from_queue, kafka_records, parse_event_lines, process_batch

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


# Measured values have two decimals. A sum of them lies on that grid, so
# rounding to two decimals removes the engines' summation noise and never meets
# a tie; averages (a sum over a small count) are rounded to nine decimals.
# Minima and maxima are values as they came and are not rounded.
SUM_DIGITS = 2
AVG_DIGITS = 9


def rounded(df: DataFrame, *cols: str, digits: int = SUM_DIGITS) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(c, digits))
    return df


# ---------------------------------------------------------------- meters ---
COUNT_CLICKS = MeterSpec("clicks", "app.click", "count", None, ("page",))
SUM_PURCHASE = MeterSpec("purchase_amount", "app.purchase", "sum", "amount", ("page",))
AVG_VIEW = MeterSpec("view_amount", "app.view", "avg", "amount", ("page",))
MIN_SIGNUP = MeterSpec("signup_amount_min", "app.signup", "min", "amount", ("page",))
MAX_ERROR = MeterSpec("error_amount_max", "app.error", "max", "amount", ("page", "k"))
UNIQUE_CLICK_K = MeterSpec("click_unique_k", "app.click", "unique_count", "k", ("page",))
HLL_CLICK_K = MeterSpec("click_unique_k_hll", "app.click", "unique_count", "k", ("page",),
                        unique_mode="hll")

MONTH_FROM = dt.datetime(2024, 1, 1)
MONTH_TO = dt.datetime(2024, 1, 31)

Q_COUNT_MINUTE = MeterQuery("minute", dt.datetime(2024, 1, 2, 0, 0, 30), dt.datetime(2024, 1, 5, 12, 0, 45))
Q_SUM_HOUR_ORG = MeterQuery("hour", MONTH_FROM, MONTH_TO, group_by=("organization",))
Q_SUM_DAY_ORG = MeterQuery("day", dt.datetime(2024, 1, 3, 5, 30), dt.datetime(2024, 1, 20, 12, 0),
                           group_by=("organization",))
Q_DAY_PAGE = MeterQuery("day", MONTH_FROM, MONTH_TO, group_by=("page",))
Q_HOUR_PAGE = MeterQuery("hour", MONTH_FROM, MONTH_TO, group_by=("page",))
Q_MAX_DAY_IN = MeterQuery("day", MONTH_FROM, MONTH_TO, group_by=("organization",),
                          filters={"page": ["p1", "p2", "p3"]})
Q_DAY_ORG = MeterQuery("day", MONTH_FROM, MONTH_TO, group_by=("organization",))
Q_RANGE_PAGE = MeterQuery(None, dt.datetime(2024, 1, 10, 6, 15, 30), dt.datetime(2024, 1, 12, 18, 45, 10),
                          group_by=("page",))
Q_MINUTE_USER_EQ = MeterQuery("minute", MONTH_FROM, MONTH_TO, group_by=("page",), filters={"user": ["usr_7"]})
Q_HOUR_FILTERS = MeterQuery("hour", MONTH_FROM, MONTH_TO, group_by=("user",),
                            filters={"organization": ["org_1", "org_2"], "page": ["p3"], "k": []})
Q_TOTAL = MeterQuery(None)
Q_HOUR_UNALIGNED = MeterQuery("hour", dt.datetime(2024, 1, 5, 10, 20, 15), dt.datetime(2024, 1, 7, 18, 10),
                              group_by=("organization", "page"))


def _shown(result: DataFrame, spec: MeterSpec) -> DataFrame:
    """Query results as they are compared (see the digits above)."""
    digits = {"sum": SUM_DIGITS, "avg": AVG_DIGITS}.get(spec.aggregation)
    return result if digits is None else rounded(result, "value", digits=digits)


def _from_rollup(spec: MeterSpec, q: MeterQuery) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        partials = minute_partials(usage_events(spark, sf_dir), spec)
        return _shown(query_rollup(partials, spec, q), spec)
    return run


def _from_events(spec: MeterSpec, q: MeterQuery) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _shown(query_events(usage_events(spark, sf_dir), spec, q), spec)
    return run


def _sql(body: str) -> str:
    return with_views(body, USAGE_EVENTS, METERED)


SQL_COUNT_MINUTE = _sql("""
select ws as windowstart, we as windowend, cast(count(*) as double) as value
from metered
where type = 'app.click' and ws >= timestamp '2024-01-02 00:00:00' and we <= timestamp '2024-01-05 12:00:00'
group by ws, we""")

SQL_SUM_HOUR_ORG = _sql("""
select date_trunc('hour', ws) as windowstart, date_trunc('hour', ws) + interval 1 hour as windowend,
       round(sum(amount), 2) as value, organization
from metered
where type = 'app.purchase' and amount is not null
  and ws >= timestamp '2024-01-01 00:00:00' and we <= timestamp '2024-01-31 00:00:00'
group by 1, 2, organization""")

SQL_SUM_DAY_ORG = _sql("""
select date_trunc('day', ws) as windowstart, date_trunc('day', ws) + interval 1 day as windowend,
       round(sum(amount), 2) as value, organization
from metered
where type = 'app.purchase' and amount is not null
  and ws >= timestamp '2024-01-03 00:00:00' and we <= timestamp '2024-01-21 00:00:00'
group by 1, 2, organization""")

SQL_AVG_DAY_PAGE = _sql("""
select date_trunc('day', ws) as windowstart, date_trunc('day', ws) + interval 1 day as windowend,
       round(avg(amount), 9) as value, page
from metered
where type = 'app.view' and amount is not null
  and ws >= timestamp '2024-01-01 00:00:00' and we <= timestamp '2024-01-31 00:00:00'
group by 1, 2, page""")

SQL_MIN_HOUR_PAGE = _sql("""
select date_trunc('hour', ws) as windowstart, date_trunc('hour', ws) + interval 1 hour as windowend,
       min(amount) as value, page
from metered
where type = 'app.signup' and amount is not null
  and ws >= timestamp '2024-01-01 00:00:00' and we <= timestamp '2024-01-31 00:00:00'
group by 1, 2, page""")

SQL_MAX_DAY_IN = _sql("""
select date_trunc('day', ws) as windowstart, date_trunc('day', ws) + interval 1 day as windowend,
       max(amount) as value, organization
from metered
where type = 'app.error' and amount is not null and page in ('p1', 'p2', 'p3')
  and ws >= timestamp '2024-01-01 00:00:00' and we <= timestamp '2024-01-31 00:00:00'
group by 1, 2, organization""")

SQL_UNIQUE_DAY_ORG = _sql("""
select date_trunc('day', ws) as windowstart, date_trunc('day', ws) + interval 1 day as windowend,
       cast(count(distinct k) as double) as value, organization
from metered
where type = 'app.click'
  and ws >= timestamp '2024-01-01 00:00:00' and we <= timestamp '2024-01-31 00:00:00'
group by 1, 2, organization""")

SQL_COUNT_RANGE_PAGE = _sql("""
select min(ws) as windowstart, max(we) as windowend, cast(count(*) as double) as value, page
from metered
where type = 'app.click'
  and ws >= timestamp '2024-01-10 06:15:30' and we <= timestamp '2024-01-12 18:45:10'
group by page""")

SQL_SUM_MINUTE_USER = _sql("""
select ws as windowstart, we as windowend, round(sum(amount), 2) as value, page
from metered
where type = 'app.purchase' and amount is not null and "user" = 'usr_7'
  and ws >= timestamp '2024-01-01 00:00:00' and we <= timestamp '2024-01-31 00:00:00'
group by ws, we, page""")

SQL_UNIQUE_HOUR_FILTERS = _sql("""
select date_trunc('hour', ws) as windowstart, date_trunc('hour', ws) + interval 1 hour as windowend,
       cast(count(distinct k) as double) as value, "user"
from metered
where type = 'app.click' and organization in ('org_1', 'org_2') and page = 'p3'
  and ws >= timestamp '2024-01-01 00:00:00' and we <= timestamp '2024-01-31 00:00:00'
group by 1, 2, "user" """)

SQL_AVG_TOTAL = _sql("""
select min(ws) as windowstart, max(we) as windowend, round(avg(amount), 9) as value
from metered
where type = 'app.view' and amount is not null""")

SQL_COUNT_HOUR_UNALIGNED = _sql("""
select date_trunc('hour', ws) as windowstart, date_trunc('hour', ws) + interval 1 hour as windowend,
       cast(count(*) as double) as value, organization, page
from metered
where type = 'app.click'
  and ws >= timestamp '2024-01-05 10:00:00' and we <= timestamp '2024-01-07 19:00:00'
group by 1, 2, organization, page""")

SQL_PARTIALS_SUM = _sql("""
select ws as windowstart, we as windowend, organization, "user", page,
       round(sum(amount), 2) as sum_v, cast(ws as date) as window_date
from metered
where type = 'app.purchase' and amount is not null
group by ws, we, organization, "user", page""")

SQL_PARTIALS_UNIQUE = _sql("""
select distinct ws as windowstart, we as windowend, organization, "user", page, k as uniq_v,
       cast(ws as date) as window_date
from metered
where type = 'app.click'""")

SQL_RESULT_RANGE = _sql("""
select greatest(min(date_trunc('day', ws)), timestamp '2024-01-03 05:30:00') as window_start,
       least(max(date_trunc('day', ws) + interval 1 day), timestamp '2024-01-20 12:00:00') as window_end
from metered
where type = 'app.purchase' and amount is not null
  and ws >= timestamp '2024-01-03 00:00:00' and we <= timestamp '2024-01-21 00:00:00'""")

SQL_SHAPED_HOUR_ORG = _sql("""
select date_trunc('hour', ws) as windowstart, date_trunc('hour', ws) + interval 1 hour as windowend,
       round(sum(amount), 2) as value,
       cast(to_json(map(['organization'], [organization])) as varchar) as group_by
from metered
where type = 'app.purchase' and amount is not null
  and ws >= timestamp '2024-01-01 00:00:00' and we <= timestamp '2024-01-31 00:00:00'
group by 1, 2, organization""")

register("q01_count_minute", SQL_COUNT_MINUTE)(_from_rollup(COUNT_CLICKS, Q_COUNT_MINUTE))
register("q02_sum_hour_by_org", SQL_SUM_HOUR_ORG)(_from_rollup(SUM_PURCHASE, Q_SUM_HOUR_ORG))
register("q03_sum_day_by_org", SQL_SUM_DAY_ORG)(_from_rollup(SUM_PURCHASE, Q_SUM_DAY_ORG))
register("q04_avg_day_by_page", SQL_AVG_DAY_PAGE)(_from_rollup(AVG_VIEW, Q_DAY_PAGE))
register("q05_min_hour_by_page", SQL_MIN_HOUR_PAGE)(_from_rollup(MIN_SIGNUP, Q_HOUR_PAGE))
register("q06_max_day_in_filter", SQL_MAX_DAY_IN)(_from_rollup(MAX_ERROR, Q_MAX_DAY_IN))
register("q07_unique_day_by_org", SQL_UNIQUE_DAY_ORG)(_from_rollup(UNIQUE_CLICK_K, Q_DAY_ORG))
register("q08_count_range_by_page", SQL_COUNT_RANGE_PAGE)(_from_rollup(COUNT_CLICKS, Q_RANGE_PAGE))
register("q09_sum_minute_user_eq", SQL_SUM_MINUTE_USER)(_from_rollup(SUM_PURCHASE, Q_MINUTE_USER_EQ))
register("q10_unique_hour_filters", SQL_UNIQUE_HOUR_FILTERS)(
    _from_rollup(UNIQUE_CLICK_K, Q_HOUR_FILTERS))
register("q11_avg_total", SQL_AVG_TOTAL)(_from_rollup(AVG_VIEW, Q_TOTAL))
register("q14_count_hour_unaligned", SQL_COUNT_HOUR_UNALIGNED)(_from_rollup(COUNT_CLICKS, Q_HOUR_UNALIGNED))
register("q15_events_sum_day_by_org", SQL_SUM_DAY_ORG)(_from_events(SUM_PURCHASE, Q_SUM_DAY_ORG))
register("q16_events_unique_day_by_org", SQL_UNIQUE_DAY_ORG)(_from_events(UNIQUE_CLICK_K, Q_DAY_ORG))
register("q17_events_count_range_by_page", SQL_COUNT_RANGE_PAGE)(_from_events(COUNT_CLICKS, Q_RANGE_PAGE))
register("q19_events_avg_total", SQL_AVG_TOTAL)(_from_events(AVG_VIEW, Q_TOTAL))


@register("m01_partials_sum", SQL_PARTIALS_SUM)
def m01_partials_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1-M6: the minute rollup of a sum meter, state column by state column."""
    return rounded(minute_partials(usage_events(spark, sf_dir), SUM_PURCHASE), "sum_v")


@register("m02_partials_unique", SQL_PARTIALS_UNIQUE)
def m02_partials_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M11 exact: one row per distinct value per minute group."""
    return minute_partials(usage_events(spark, sf_dir), UNIQUE_CLICK_K)


def _from_bitmaps(q: MeterQuery, merged: bool) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Two batches of events; the dictionary grows with the
        second, and both batches' states are read together."""
        root, events, states = _scratch(spark, "m11"), usage_events(spark, sf_dir), None
        for source in ("web_api", "mobile_api"):
            batch = events.where(F.col("source") == source)
            values = extract(batch, UNIQUE_CLICK_K).select(F.col(VALUE).alias("uniq_v"))
            batch_states = bitmap_partials(batch, UNIQUE_CLICK_K, add_values(values, f"{root}/dictionary"))
            batch_states.write.partitionBy("window_date").parquet(f"{root}/states/{source}")
            own = spark.read.parquet(f"{root}/states/{source}")
            states = own if states is None else states.unionByName(own)
        return query_bitmaps(merge_bitmaps(states, UNIQUE_CLICK_K) if merged else states, UNIQUE_CLICK_K, q)
    return run


register("m11_bitmap_unique", SQL_UNIQUE_DAY_ORG)(_from_bitmaps(Q_DAY_ORG, merged=False))
register("m11_bitmap_unique_compacted", SQL_UNIQUE_HOUR_FILTERS)(_from_bitmaps(Q_HOUR_FILTERS, merged=True))


@register("m03_compacted_sum", SQL_PARTIALS_SUM)
def m03_compacted_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partials built from two halves of the events, then compacted,
    equal the partials built at once (merge law)."""
    events = usage_events(spark, sf_dir)
    halves = [minute_partials(events.where(F.col("source") == s), SUM_PURCHASE)
              for s in ("web_api", "mobile_api")]
    return rounded(compact_partials(halves[0].unionByName(halves[1]), SUM_PURCHASE), "sum_v")


def _by_text(index: str, pick: Callable[[tuple], str], other: str) -> str:
    whens = " ".join(f"when {i} then {pick(pair)}" for i, pair in VALUE_TEXTS.items())
    return f"case {index} {whens} else {other} end"


@register("m03_value_texts", _sql(f"""
select ws as windowstart, we as windowend, organization, "user", page,
       round(sum(v), 2) as sum_v, cast(ws as date) as window_date
from (select *, {_by_text("cast(id[5:] as bigint) % 12", lambda p: "null" if p[1] is None else str(p[1]), "amount")} as v from metered)
where type = 'app.purchase' and v is not null
group by ws, we, organization, "user", page"""))
def m03_value_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: only texts that write out a decimal number are measured."""
    events = usage_events(spark, sf_dir)
    text = F.expr(_by_text("cast(substring(id, 5) as bigint) % 12", lambda p: f"'{p[0]}'", "props['amount']"))
    swapped = (events.withColumn("props", F.from_json("properties", "map<string,string>"))
               .withColumn("properties", F.to_json(F.map_concat(
                   F.map_filter("props", lambda k, _: k != "amount"), F.create_map(F.lit("amount"), text)))).drop("props"))
    return rounded(minute_partials(swapped, SUM_PURCHASE), "sum_v")


@register("m04_unique_hll_day", SQL_UNIQUE_DAY_ORG.replace("cast(count(distinct k) as double) as value", "true as close"))
def m04_unique_hll_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M11/Q9 approximate: HLL sketches per minute, unioned per day, are within
    5 % (and one) of the exact counts in every window."""
    events = usage_events(spark, sf_dir)
    sketched = query_rollup(minute_partials(events, HLL_CLICK_K), HLL_CLICK_K, Q_DAY_ORG)
    exact = query_events(events, UNIQUE_CLICK_K, Q_DAY_ORG).withColumnRenamed("value", "exact")
    return (sketched.join(exact, ["windowstart", "windowend", "organization"], "full")
            .withColumn("close", F.coalesce(F.abs(F.col("value") - F.col("exact")) <= 0.05 * F.col("exact") + 1, F.lit(False)))
            .select("windowstart", "windowend", "close", "organization"))


def _scratch(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def _raw(events: DataFrame) -> DataFrame:
    """Typed events in the API's form."""
    return events.select("id", "type", "source", "organization", "user",
                         F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "properties")


@register("q20_day_from_stored_rollup", SQL_SUM_DAY_ORG)
def q20_day_from_stored_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two epochs of all meters written to storage, one meter
    compacted, a third epoch replayed; the query reads the stored rollup."""
    events, root = usage_events(spark, sf_dir), _scratch(spark, "q20")
    specs = [SUM_PURCHASE, COUNT_CLICKS, UNIQUE_CLICK_K, HLL_CLICK_K]
    thirds = [events.where(F.pmod(F.xxhash64("id"), F.lit(3)) == i) for i in range(3)]
    for epoch in (0, 1):
        store.write_epoch_of_all(thirds[epoch], root, specs, epoch)
    store.compact(spark, root, SUM_PURCHASE)
    for _ in range(2):
        store.write_epoch_of_all(thirds[2], root, specs, 2)
    return _shown(query_rollup(store.read_rollup(spark, root, SUM_PURCHASE), SUM_PURCHASE, Q_SUM_DAY_ORG), SUM_PURCHASE)


def _from_tiers(spark: SparkSession, sf_dir: str, spec: MeterSpec, q: MeterQuery) -> DataFrame:
    """The query from written tiers of three quarters of the events, the rest as
    minutes that came later."""
    events = usage_events(spark, sf_dir)
    late = F.pmod(F.xxhash64("id"), F.lit(4)) == 0
    tiers = {"minute": materialize(minute_partials(events.where(~late), spec), f"tier-{uuid.uuid4().hex}")}
    for finer, size in (("minute", "hour"), ("hour", "day")):
        tiers[size] = materialize(build_tier(tiers[finer], spec, size), f"tier-{uuid.uuid4().hex}")
    return _shown(query_tiers(tiers, spec, q, later=minute_partials(events.where(late), spec)), spec)


@register("q21_range_from_tiers", SQL_COUNT_RANGE_PAGE)
def q21_range_from_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4: q08 answered from minutes at the edges, hours and days between."""
    return _from_tiers(spark, sf_dir, COUNT_CLICKS, Q_RANGE_PAGE)


@register("q21_unique_day_from_tiers", SQL_UNIQUE_DAY_ORG)
def q21_unique_day_from_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3, Q9: q07 answered from the day tier."""
    return _from_tiers(spark, sf_dir, UNIQUE_CLICK_K, Q_DAY_ORG)


@register("q21_count_hour_unaligned_from_tiers", SQL_COUNT_HOUR_UNALIGNED)
def q21_count_hour_unaligned_from_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2, Q15: q14 answered from the hour tier."""
    return _from_tiers(spark, sf_dir, COUNT_CLICKS, Q_HOUR_UNALIGNED)


@register("m13_backfill_during_compaction", SQL_SUM_DAY_ORG)
def m13_backfill_during_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backfill that saw batches 1 and 2 lands after a compaction folded 1
    to 3. The layer that straddles it wins; nothing is counted twice."""
    events, root = usage_events(spark, sf_dir), _scratch(spark, "m13")
    thirds = [events.where(F.pmod(F.xxhash64("id"), F.lit(3)) == i) for i in range(3)]
    for epoch, part in enumerate(thirds):
        store.write_epoch(minute_partials(part, SUM_PURCHASE), root, SUM_PURCHASE, epoch)
    store.compact(spark, root, SUM_PURCHASE)
    store.write_batch(minute_partials(thirds[0].unionByName(thirds[1]), SUM_PURCHASE), root, SUM_PURCHASE, "f2")
    return _shown(query_rollup(store.read_rollup(spark, root, SUM_PURCHASE), SUM_PURCHASE, Q_SUM_DAY_ORG), SUM_PURCHASE)


@register("m12_late_batch_below_layer", SQL_SUM_DAY_ORG)
def m12_late_batch_below_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches 4 and 5 are folded; 2, 7 and, of another run, 4 arrive and are
    folded too: the layers cover exactly these. A reader planned before sees no change."""
    events, root = usage_events(spark, sf_dir), _scratch(spark, "m12")
    parts = [events.where(F.pmod(F.xxhash64("id"), F.lit(5)) == i) for i in range(5)]

    def write(part: int, number: int, run: str = "") -> None:
        store.write_epoch(minute_partials(parts[part], SUM_PURCHASE), root, SUM_PURCHASE, number - 1, run)

    write(0, 4)
    write(1, 5)
    store.compact(spark, root, SUM_PURCHASE)
    write(2, 2)
    write(3, 7)
    write(4, 4, "other")
    before = store.read_rollup(spark, root, SUM_PURCHASE)
    store.compact(spark, root, SUM_PURCHASE)
    write(2, 2)  # a replay of what is folded
    store.compact(spark, root, SUM_PURCHASE, full=True)
    now = store.read_rollup(spark, root, SUM_PURCHASE)
    same = query_rollup(before, SUM_PURCHASE, Q_SUM_DAY_ORG).join(
        query_rollup(now, SUM_PURCHASE, Q_SUM_DAY_ORG).withColumnRenamed("value", "now"), ["windowstart", "windowend", "organization"], "full")
    agree = F.abs(F.col("value") - F.col("now")) <= 1e-6 * F.abs(F.col("now"))
    return _shown(same.withColumn("value", F.when(agree, F.col("now"))).drop("now"), SUM_PURCHASE)


@register("m13_resumed_backfill", SQL_SUM_DAY_ORG)
def m13_resumed_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A meter added to a running ingest. Its backfill stops after the first
    of three chunks, an epoch is replayed, and the backfill goes on."""
    root, raw, meters = _scratch(spark, "m13r"), _raw(usage_events(spark, sf_dir)), dirty_meters(spark, sf_dir)
    paths = [f"{root}/{k}" for k in ("events", "rejects", "rollups")]
    parts = [raw.where(F.pmod(F.xxhash64("id"), F.lit(3)) == i) for i in range(3)]
    for epoch, part in enumerate(parts):
        process_batch(part, epoch, meters, [], *paths, tenant=DIRTY_TENANT)
    spec = dataclasses.replace(SUM_PURCHASE, tenant_slug=DIRTY_TENANT)
    store.backfill_from_events_table(spark, paths[0], paths[2], [spec], f"{root}/long", per_chunk=1, max_chunks=1)
    process_batch(parts[0], 0, meters, [spec], *paths, tenant=DIRTY_TENANT)
    store.backfill_from_events_table(spark, paths[0], paths[2], [spec], f"{root}/longer", per_chunk=1)
    return _shown(query_rollup(store.read_rollup(spark, paths[2], spec), spec, Q_SUM_DAY_ORG), spec)


@register("m14_restarted_checkpoint", SQL_SUM_DAY_ORG)
def m14_restarted_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream started anew numbers its epochs from 0 again. What the
    first one wrote, folded or not, stays, and both count."""
    root, raw, meters = _scratch(spark, "m14"), _raw(usage_events(spark, sf_dir)), dirty_meters(spark, sf_dir)
    paths = [f"{root}/{k}" for k in ("events", "rejects", "rollups")]
    spec = dataclasses.replace(SUM_PURCHASE, tenant_slug=DIRTY_TENANT)
    parts = [raw.where(F.pmod(F.xxhash64("id"), F.lit(4)) == i) for i in range(4)]
    for part, (epoch, run) in enumerate(((0, "first"), (1, "first"), (0, "second"), (1, "second"))):
        process_batch(parts[part], epoch, meters, [spec], *paths, tenant=DIRTY_TENANT, run=run)
        if part == 1:
            store.compact_all(spark, paths[2], [spec])
    stored = query_events(read_events(spark, paths[0]), spec, Q_SUM_DAY_ORG).withColumnRenamed("value", "of_events")
    rolled = query_rollup(store.read_rollup(spark, paths[2], spec), spec, Q_SUM_DAY_ORG)
    agree = F.abs(F.col("value") - F.col("of_events")) <= 1e-6 * F.abs(F.col("of_events"))
    both = rolled.join(stored, ["windowstart", "windowend", "organization"], "full")
    return _shown(both.withColumn("value", F.when(agree, F.col("value"))).drop("of_events"), spec)


@register("s02_two_tenants_one_events_path", with_views("""
select tenant, type, count(*) as events, count(distinct id) as ids from (
  select *, case when cast(id[5:] as bigint) % 2 = 0 then 'acme' else 'other' end as tenant from usage_events)
group by tenant, type""", USAGE_EVENTS))
def s02_two_tenants_one_events_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tenants' jobs with equal epochs share one events path."""
    root, raw, out = _scratch(spark, "s02"), _raw(usage_events(spark, sf_dir)), None
    for i, tenant in enumerate(("acme", "other")):
        meters = dirty_meters(spark, sf_dir).withColumn("tenant_slug", F.lit(tenant))
        process_batch(raw.where(_number(F.col("id")) % 2 == i), 0, meters, [], *(f"{root}/{k}" for k in ("events", "rejects", "rollups")), tenant=tenant)
    for tenant in ("acme", "other"):
        own = read_events(spark, f"{root}/events", tenant=tenant).withColumn("tenant", F.lit(tenant))
        out = own if out is None else out.unionByName(own)
    return out.groupBy("tenant", "type").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("id").alias("ids"))


SQL_EVENTS_SCAN = with_views("""
select id, type, source, organization, "user", "timestamp", properties from usage_events
where type = 'app.purchase' and "timestamp" >= timestamp '2024-01-03' and "timestamp" < timestamp '2024-01-09'""", USAGE_EVENTS)


def _folded_events(spark: SparkSession, sf_dir: str, root: str) -> list[str]:
    """Three batches of two runs, folded, then a fourth; the folder's paths."""
    raw, meters = _raw(usage_events(spark, sf_dir)), dirty_meters(spark, sf_dir)
    paths = [f"{root}/{k}" for k in ("events", "rejects", "rollups")]
    for part, (epoch, run) in enumerate(((0, "first"), (1, "first"), (0, "second"), (1, "second"))):
        process_batch(raw.where(F.pmod(F.xxhash64("id"), F.lit(4)) == part), epoch, meters, [], *paths, tenant=DIRTY_TENANT, run=run)
        if part == 2:
            fold_events(spark, paths[0], DIRTY_TENANT)
    return paths


@register("s03_folded_events_scan", SQL_EVENTS_SCAN)
def s03_folded_events_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s03 from a layer of folded batches, by its files' types and
    times, and a batch that came later."""
    paths = _folded_events(spark, sf_dir, _scratch(spark, "s03f"))
    found = read_events(spark, paths[0], dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 9), "app.purchase", tenant=DIRTY_TENANT)
    return found.select("id", "type", "source", "organization", "user", "timestamp", "properties")


@register("m13_backfill_from_folded_events", SQL_SUM_DAY_ORG)
def m13_backfill_from_folded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A meter backfilled in chunks from folded events; a chunk takes some
    of a layer's batches, and only files with the meter's type."""
    root = _scratch(spark, "m13f")
    paths, spec = _folded_events(spark, sf_dir, root), dataclasses.replace(SUM_PURCHASE, tenant_slug=DIRTY_TENANT)
    store.backfill_from_events_table(spark, paths[0], paths[2], [spec], f"{root}/long", per_chunk=2)
    return _shown(query_rollup(store.read_rollup(spark, paths[2], spec), spec, Q_SUM_DAY_ORG), spec)


@register("s03_events_scan", SQL_EVENTS_SCAN)
def s03_events_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as the ingest job does, read back by date and type."""
    path, events = _scratch(spark, "s03"), usage_events(spark, sf_dir)
    for batch in (0, 1):
        (events.where(F.pmod(F.xxhash64("id"), F.lit(2)) == batch).withColumn("event_date", F.to_date("timestamp"))
         .write.partitionBy("event_date").parquet(f"{path}/batch_id={batch + 1}"))
    found = read_events(spark, path, dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 9), "app.purchase")
    return found.select("id", "type", "source", "organization", "user", "timestamp", "properties")


def _queue_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kafka_records(usage_events(spark, sf_dir))


@register("s06_drop_keeps_other_meters", SQL_SUM_DAY_ORG)
def s06_drop_keeps_other_meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two meters written in one epoch one is dropped; its rows are gone
    (they would add to the result) and the other meter answers as before."""
    root, other = _scratch(spark, "s06"), dataclasses.replace(SUM_PURCHASE, slug="dropped")
    store.write_epoch_of_all(usage_events(spark, sf_dir), root, [SUM_PURCHASE, other], 0)
    store.drop_rollup(spark, root, other)
    gone = query_rollup(store.read_rollup(spark, root, other), other, Q_SUM_DAY_ORG)
    kept = query_rollup(store.read_rollup(spark, root, SUM_PURCHASE), SUM_PURCHASE, Q_SUM_DAY_ORG)
    return _shown(kept.unionByName(gone), SUM_PURCHASE)


@register("s09_catalog_scan", with_views("select id, slug, name, type, tenant_slug, created_at, archived_at from plans_t", TENANTS, PLANS))
def s09_catalog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog table read from storage."""
    path = _scratch(spark, "s09")
    fx.plans(spark, sf_dir).write.parquet(path)
    return read_catalog(spark, "plan", path).select("id", "slug", "name", "type", "tenant_slug", "created_at", "archived_at")


@register("v00_nil_events", """
select case when event_id % 10 < 2 then 'nil_event' end as reason, count(*) as events from events group by 1""")
def v00_nil_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: lines that are no JSON object are nil events."""
    n = _number(F.get_json_object("value", "$.id"))
    broken = F.when(n % 10 == 0, F.substring("value", 2, 1 << 20)).when(n % 10 == 1, F.concat(F.lit("["), "value", F.lit("]")))
    lines = _queue_lines(spark, sf_dir).withColumn("value", F.coalesce(broken, "value"))
    raw = from_queue(parse_event_lines(lines))
    return ingest.reason_counts(ingest.validate(raw, dirty_meters(spark, sf_dir), tenant=DIRTY_TENANT))


@register("s01_queue_lines", with_views("""
select id, type, source, organization, "user", "timestamp", properties from usage_events""", USAGE_EVENTS))
def s01_queue_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as the topic carries them, parsed, validated and stored."""
    raw = from_queue(parse_event_lines(_queue_lines(spark, sf_dir)))
    return ingest.typed_events(ingest.validate(raw, dirty_meters(spark, sf_dir), tenant=DIRTY_TENANT))


@register("s07_kafka_records", with_views("""
select concat(organization, '-', "user") as key, id, strftime("timestamp", '%Y-%m-%dT%H:%M:%S') as ts, properties,
       'content-type: application/json' as header from usage_events""", USAGE_EVENTS))
def s07_kafka_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of accepted events: key, value fields, header."""
    value = F.from_json("value", "id string, timestamp string, properties string")
    header = F.concat("headers.key", F.array(F.lit(": ")), F.transform("headers.value", lambda v: v.cast("string")))
    return _queue_lines(spark, sf_dir).select(
        "key", value.alias("v"), F.array_join(header, "").alias("header")).select(
        "key", "v.id", F.col("v.timestamp").alias("ts"), "v.properties", "header")


@register("q12_result_range", SQL_RESULT_RANGE)
def q12_result_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q17: the response envelope's window range for q03."""
    result = _from_rollup(SUM_PURCHASE, Q_SUM_DAY_ORG)(spark, sf_dir)
    return result_range(result, Q_SUM_DAY_ORG)


@register("q13_rows_shaped", SQL_SHAPED_HOUR_ORG)
def q13_rows_shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q18: dimensions packed into a map (shown as JSON text)."""
    result = _from_rollup(SUM_PURCHASE, Q_SUM_HOUR_ORG)(spark, sf_dir)
    shaped = shape_rows(result, Q_SUM_HOUR_ORG)
    return shaped.withColumn("group_by", F.to_json("group_by"))


FLAGSHIP = "q03_sum_day_by_org"


def queries() -> dict[str, QueryFn]:
    return {name: fn for name, (fn, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql is not None}


# ---------------------------------------------------------------- ingest ---

DIRTY_TENANT = "acme"


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.validate(dirty_raw_events(spark, sf_dir), dirty_meters(spark, sf_dir), tenant=DIRTY_TENANT)


@register("l03_required_properties", """
select distinct concat('app.', event_type) as event_type, 'amount,k,page' as required from events""")
def l03_required_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2-L3: required properties per event type of the tenant's meters."""
    req = ingest.required_properties(ingest.meters_for_types(dirty_meters(spark, sf_dir), tenant=DIRTY_TENANT))
    return req.select("event_type", F.array_join("required", ",").alias("required"))


@register("l03_two_tenants", """
select distinct concat('app.', event_type) as event_type, t.tenant_slug,
       case t.tenant_slug when 'acme' then 'amount,k,page' else 'only_other' end as required
from events, (select unnest(['acme', 'other']) as tenant_slug) t""")
def l03_two_tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: another tenant's meters add nothing to a tenant's required properties."""
    own = dirty_meters(spark, sf_dir)
    other = own.withColumns({"tenant_slug": F.lit("other"), "properties": F.array(F.lit("only_other")),
                             "value_property": F.lit(None).cast("string")})
    req = ingest.required_properties(own.unionByName(other), ("tenant_slug", "event_type"))
    return req.select("event_type", "tenant_slug", F.array_join("required", ",").alias("required"))


@register("i02_default_id_and_time", """
select concat('evt_', cast(event_id as varchar)) as source, event_id % 3 = 0 as own_id, event_id % 5 = 0 as own_time
from events""")
def i02_default_id_and_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty id becomes a uuid, an empty timestamp the present second."""
    n = _number(F.col("id"))
    raw = usage_events(spark, sf_dir).select(
        F.when(n % 3 != 0, F.col("id")).otherwise("").alias("id"), "type", F.col("id").alias("source"), "organization", "user",
        F.when(n % 5 != 0, F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("").alias("timestamp"), "properties")
    out = ingest.typed_events(ingest.validate(raw, dirty_meters(spark, sf_dir), tenant=DIRTY_TENANT))
    age = F.unix_seconds(F.current_timestamp()) - F.unix_seconds("timestamp")
    return out.select("source", F.col("id").rlike(ingest.UUID_PATTERN).alias("own_id"), F.abs(age).between(0, 86400).alias("own_time"))


@register("i02_stable_ids", with_views("""
select md5(concat('acme/0|=', type, '|=', source, '|=', organization, '|=', "user", '|=', strftime("timestamp", '%Y-%m-%dT%H:%M:%SZ'),
                  '|=', properties, '|', cast(row_number() over (
                    partition by type, source, organization, "user", "timestamp", properties) as varchar))) as id_digits,
       type, "user", "timestamp", true as same_again
from usage_events""", USAGE_EVENTS))
def i02_stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without ids, some of them equal, ingested and replayed:
    the replay gives every event the id it had."""
    root, meters = _scratch(spark, "i02"), dirty_meters(spark, sf_dir)
    raw = usage_events(spark, sf_dir).select(
        F.lit("").alias("id"), "type", "source", "organization", "user",
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "properties")
    seen = []
    for attempt in range(2):
        process_batch(raw.repartition(3 + attempt), 0, meters, [], f"{root}/events", f"{root}/rejects", f"{root}/rollups",
                      tenant=DIRTY_TENANT, run=DIRTY_TENANT)
        seen.append(read_events(spark, f"{root}/events").select("id", "type", "user", "timestamp"))
    again = seen[1].select("id", F.lit(True).alias("found"))
    return seen[0].join(again, "id", "left").select(
        F.replace(F.col("id"), F.lit("-"), F.lit("")).alias("id_digits"), "type", "user", "timestamp",
        F.coalesce("found", F.lit(False)).alias("same_again"))


# Properties with repeated keys by event_id % 6, and what V4 to V6 say of them.
REPEATED = (('{"k":"","k":"a","page":"p","amount":1}', None),
            ('{"k":"a","page":"p","amount":1,"k":""}', "missing_properties"),
            ('{"k":"a","page":"p","amount":1,"page":[]}', "missing_properties"),
            ('{"k":"a","page":{"x":1,"x":2},"amount":[],"amount":0}', None),
            ('{"k":"a","k":null,"page":{"x":{},"x":2},"amount":1}', "missing_properties"),
            ('{"k":"a","page":"p","amount":1} {"k":"a"}', "invalid_properties"))


@register("v04_repeated_keys", f"""
select concat('evt_', cast(event_id as varchar)) as id,
       case event_id % 6 {" ".join(f"when {i} then {'null' if r is None else repr(r)}" for i, (_, r) in enumerate(REPEATED))} end as reason
from events""")
def v04_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4, V6: of a repeated key the last value counts, at any depth; text after the object is an error."""
    texts = F.array(*(F.lit(text) for text, _ in REPEATED))
    raw = usage_events(spark, sf_dir).select(
        "id", "type", "source", "organization", "user", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.element_at(texts, (_number(F.col("id")) % 6 + 1).cast("int")).alias("properties"))
    return ingest.validate(raw, dirty_meters(spark, sf_dir), tenant=DIRTY_TENANT).select("id", "reason")


# Batches of the dirty fixture by event_id % 50, and strict mode's answer.
STRICT_BATCHES = (("clean", (1, 2, 3, 4, 5, 45), None), ("one defect", (1, 2, 17), "missing_properties"),
                  ("bad time", (3, 43), "invalid_timestamp"), ("unknown type", (4, 11), "missing_meter"),
                  ("no type", (7,), "no event of the batch names a type"), ("nothing", (), "the batch holds no events"))


@register("v08_strict_batch", " union all ".join(
    f"select '{name}' as batch, {'count(*)' if error is None else '0 * count(*)'} as accepted, {'null' if error is None else repr(error)} as error"
    f" from events where event_id % 50 in ({', '.join(map(str, rows or (-1,)))})" for name, rows, error in STRICT_BATCHES))
def v08_strict_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8 strict, L1: batches handed to the publish call, and what it accepts or answers."""
    raw, meters = dirty_raw_events(spark, sf_dir), dirty_meters(spark, sf_dir)
    out = None
    for name, rows, _ in STRICT_BATCHES:
        batch, error, accepted = raw.where((F.col("seq") % 50).isin(*rows)), None, None
        try:
            accepted, _ = ingest.publish(batch, meters, tenant=DIRTY_TENANT, allow_partial_success=False)
        except ingest.BatchRejected as e:
            error = str(e).removeprefix("batch rejected: ")
        except ingest.BatchError as e:
            error = str(e)
        counted = (accepted if accepted is not None else batch.limit(0)).agg(F.count(F.lit(1)).alias("accepted"))
        row = counted.select(F.lit(name).alias("batch"), "accepted", F.lit(error).cast("string").alias("error"))
        out = row if out is None else out.unionAll(row)
    return out


@register("m10_count_values", with_views("""
select date_trunc('day', "timestamp") as windowstart, date_trunc('day', "timestamp") + interval 1 day as windowend,
       cast(count(*) as double) as value, organization
from accepted where type = 'app.purchase' and event_id % 50 <> 41
  and "timestamp" >= timestamp '2024-01-01' and "timestamp" < timestamp '2024-01-31'
group by 1, 2, organization""", DIRTY_ACCEPTED))
def m10_count_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A count meter with a value counts the events whose value is a number."""
    spec = MeterSpec("priced", "app.purchase", "count", "amount", ("page",), count_values=True)
    valid, _ = ingest.split(_validated(spark, sf_dir))
    return query_rollup(minute_partials(valid, spec), spec, Q_DAY_ORG)


@register("v01_validation_reasons", f"""
select concat('evt_', cast(event_id as varchar)) as id, {DIRTY_REASON} as reason from events""")
def v01_validation_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First failing rule per event (null = accepted)."""
    return _validated(spark, sf_dir).select("id", "reason")


@register("v02_reason_counts", f"""
select {DIRTY_REASON} as reason, count(*) as events from events group by 1""")
def v02_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9: accepted (null) and rejected events per reason."""
    return ingest.reason_counts(_validated(spark, sf_dir))


@register("v03_accepted_events", with_views("""
select id, type, source, organization, "user", "timestamp", properties from accepted""", DIRTY_ACCEPTED))
def v03_accepted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted events in stored form."""
    valid, _ = ingest.split(_validated(spark, sf_dir))
    return valid


@register("v04_missing_properties", f"""
select concat('evt_', cast(event_id as varchar)) as id, {DIRTY_MISSING} as missing
from events where ({DIRTY_REASON}) = 'missing_properties'""")
def v04_missing_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The missing or empty required names of each reject."""
    _, rejected = ingest.split(_validated(spark, sf_dir))
    return (rejected.where(F.col("reason") == "missing_properties")
            .select("id", F.array_join("missing", ",").alias("missing")))


@register("v05_ingested_sum_day_by_org", with_views("""
select date_trunc('day', "timestamp") as windowstart,
       date_trunc('day', "timestamp") + interval 1 day as windowend,
       round(sum(case when event_id % 100 = 45 then 0 else value end), 2) as value, organization
from accepted
where type = 'app.purchase' and event_id % 50 <> 41
group by 1, 2, organization""", DIRTY_ACCEPTED))
def v05_ingested_sum_day_by_org(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest -> rollup -> query: only accepted, numeric events are metered."""
    valid, _ = ingest.split(_validated(spark, sf_dir))
    partials = minute_partials(valid, SUM_PURCHASE)
    return rounded(query_rollup(partials, SUM_PURCHASE, Q_DAY_ORG), "value")


@register("v06_non_numeric_rejects", """
select concat('evt_', cast(event_id as varchar)) as id, 'non_numeric_value' as reason
from events where event_type = 'purchase' and event_id % 50 = 41""")
def v06_non_numeric_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """accepted events a numeric meter cannot measure."""
    valid, _ = ingest.split(_validated(spark, sf_dir))
    return rollup_rejects(valid, SUM_PURCHASE).select("id", "reason")


# --------------------------------------------------------------- catalog ---


def _cat_sql(body: str, *views: str) -> str:
    return with_views(body, TENANTS, *views)


@register("c01_meter_counts_by_tenant", _cat_sql("""
select tenant_slug, count(*) as meters from meters_t group by tenant_slug""", METERS))
def c01_meter_counts_by_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meters per tenant."""
    return cat.meter_counts(fx.meters(spark, sf_dir))


@register("c01_meter_counts_by_event_type", _cat_sql("""
select tenant_slug, event_type, count(*) as meters from meters_t group by tenant_slug, event_type""", METERS))
def c01_meter_counts_by_event_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meters per (tenant, event type)."""
    return cat.meter_counts(fx.meters(spark, sf_dir), by=("tenant_slug", "event_type"))


@register("c02_value_properties", _cat_sql("""
select distinct tenant_slug, event_type, value_property from meters_t where value_property is not null""",
                                           METERS))
def c02_value_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct value properties per tenant and event type."""
    return cat.value_properties(fx.meters(spark, sf_dir))


@register("c03_event_properties", _cat_sql("""
select distinct tenant_slug, event_type, unnest(properties) as property from meters_t""", METERS))
def c03_event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct unnested properties per tenant and event type."""
    return cat.event_properties(fx.meters(spark, sf_dir))


@register("c04_meters_page", _cat_sql("""
select m.id, m.slug, t.tenant_slug, m.created_at, m.position, t.total
from (select tenant_slug, count(*) as total from meters_t group by tenant_slug) t left join (
  select *, row_number() over (partition by tenant_slug order by created_at desc, id desc) as position
  from meters_t) m on m.tenant_slug = t.tenant_slug and m.position between 21 and 40""", METERS))
def c04_meters_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: page 2 (limit 20) of every tenant's meters, newest first, with the total."""
    page = cat.meters_page(fx.meters(spark, sf_dir), cat.Page(2, 20))
    return page.select("id", "slug", "tenant_slug", "created_at", "position", "total")


@register("c06_plans_page", _cat_sql("""
select p.id, t.tenant_slug, p.type, p.created_at, p.position, t.total
from (select tenant_slug, count(*) as total from plans_t where archived_at is null group by tenant_slug) t
left join (
  select *, row_number() over (partition by tenant_slug order by created_at desc, id desc) as position
  from plans_t where archived_at is null) p on p.tenant_slug = t.tenant_slug and p.position <= 3""", PLANS))
def c06_plans_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 3 non-archived plans per tenant, with the total."""
    page = cat.plans_page(fx.plans(spark, sf_dir), cat.Page(1, 3), archived=False)
    return page.select("id", "tenant_slug", "type", "created_at", "position", "total")


@register("c06_page_past_end", _cat_sql("""
select cast(null as varchar) as id, tenant_slug, cast(null as bigint) as position, count(*) as total
from plans_t group by tenant_slug""", PLANS))
def c06_page_past_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page past the end has no plans, but still the total."""
    return cat.plans_page(fx.plans(spark, sf_dir), cat.Page(9, 20)).select("id", "tenant_slug", "position", "total")


@register("c07_features_page", _cat_sql("""
select f.id, t.tenant_slug, f.type, f.created_at, f.position, t.total
from (select tenant_slug, count(*) as total from features_t where type = 'metered' group by tenant_slug) t
left join (
  select *, row_number() over (partition by tenant_slug order by created_at desc, id desc) as position
  from features_t where type = 'metered') f on f.tenant_slug = t.tenant_slug and f.position between 11 and 20""", FEATURES))
def c07_features_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 2 (limit 10) of metered features per tenant, with the total."""
    page = cat.features_page(fx.features(spark, sf_dir), cat.Page(2, 10), feature_type="metered")
    return page.select("id", "tenant_slug", "type", "created_at", "position", "total")


@register("c08_plan_features", _cat_sql("""
select pf.id as plan_feature_id, pf.plan_id, pf.feature_id, pf.config, pf.created_at,
       f.name as feature_name, f.slug as feature_slug, f.type as feature_type, f.config as feature_config,
       p.tenant_slug
from plan_features_t pf join features_t f on pf.feature_id = f.id join plans_t p on pf.plan_id = p.id""",
                                        PLANS, FEATURES, LINKS, PLAN_FEATURES))
def c08_plan_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan-features with feature and plan columns."""
    listing = cat.plan_features_listing(fx.plan_features(spark, sf_dir), fx.features(spark, sf_dir),
                                        fx.plans(spark, sf_dir))
    return listing.drop("config_json")  # compared in c08_config_json


@register("c09_link_check", _cat_sql("""
select l.plan_id, l.feature_id, l.tenant_slug,
       coalesce(exists (select 1 from plans_t p join features_t f on p.tenant_slug = f.tenant_slug
                        where p.id = l.plan_id and f.id = l.feature_id and p.tenant_slug = l.tenant_slug), false)
         as allowed
from links_t l""", PLANS, FEATURES, LINKS))
def c09_link_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """May this feature be attached to this plan within the tenant?"""
    req = fx.link_requests(spark, sf_dir).select("plan_id", "feature_id", "tenant_slug")
    return cat.tenant_link_check(req, fx.plans(spark, sf_dir), fx.features(spark, sf_dir))


@register("c10_plan_feature_ids", _cat_sql("""
select l.plan_id, l.feature_id, l.tenant_slug, pf.id as plan_feature_id
from links_t l join plan_features_t pf on pf.plan_id = l.plan_id and pf.feature_id = l.feature_id
join plans_t p on pf.plan_id = p.id join features_t f on pf.feature_id = f.id
where p.tenant_slug = l.tenant_slug""", PLANS, FEATURES, LINKS, PLAN_FEATURES))
def c10_plan_feature_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolve (plan, feature, tenant) to the plan-feature id."""
    req = fx.link_requests(spark, sf_dir).select("plan_id", "feature_id", "tenant_slug")
    return cat.plan_feature_ids(req, fx.plan_features(spark, sf_dir), fx.plans(spark, sf_dir),
                                fx.features(spark, sf_dir))


@register("c11_unmetered_quotas", _cat_sql("""
select q.id, q.plan_feature_id from quotas_t q
where not exists (select 1 from features_t f join plan_features_t pf on f.id = pf.feature_id
                  where pf.id = q.plan_feature_id and f.type = 'metered')""",
                                           FEATURES, LINKS, PLAN_FEATURES, QUOTAS))
def c11_unmetered_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: quotas on plan-features whose feature is not metered."""
    return cat.unmetered_quotas(fx.quotas(spark, sf_dir), fx.plan_features(spark, sf_dir),
                                fx.features(spark, sf_dir)).select("id", "plan_feature_id")


@register("c12_entitlements", _cat_sql("""
select p.tenant_slug, pf.plan_id, pf.feature_id, pf.id as plan_feature_id, f.type as feature_type,
       q.limit_value, q.reset_period, q.custom_period_minutes, q.action_at_limit
from plan_features_t pf join features_t f on pf.feature_id = f.id join plans_t p on pf.plan_id = p.id
left join quotas_t q on q.plan_feature_id = pf.id""", PLANS, FEATURES, LINKS, PLAN_FEATURES, QUOTAS))
def c12_entitlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan-features with their quota definition (if any)."""
    return cat.entitlements(fx.plan_features(spark, sf_dir), fx.features(spark, sf_dir),
                            fx.plans(spark, sf_dir), fx.quotas(spark, sf_dir))


@register("c13_quota_violations", _cat_sql("""
select id, plan_feature_id, violation from (
  select q.id, q.plan_feature_id, unnest([
    case when reset_period = 'custom' and custom_period_minutes is null then 'custom_without_minutes' end,
    case when reset_period <> 'custom' and custom_period_minutes is not null then 'minutes_without_custom' end,
    case when custom_period_minutes is not null and custom_period_minutes <= 0 then 'non_positive_minutes' end,
    case when limit_value <= 0 then 'non_positive_limit' end,
    case when reset_period not in ('day','week','month','year','custom','rolling','never')
         then 'unknown_reset_period' end,
    case when action_at_limit not in ('none','block','throttle') then 'unknown_action' end,
    case when (select count(*) from quotas_t q2 where q2.plan_feature_id = q.plan_feature_id) > 1
         then 'duplicate_plan_feature' end]) as violation
  from quotas_t q) where violation is not null""", LINKS, QUOTAS))
def c13_quota_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quota rows breaking the table's CHECK/unique rules."""
    return cat.quota_violations(fx.quotas(spark, sf_dir))


@register("c14_assignments_page", _cat_sql("""
select a.id, a.plan_id, a.organization_id, a.user_id, a.valid_from, a.valid_until, a.created_at,
       t.tenant_slug, a.position, t.total from (
  select x.*, p.tenant_slug,
         row_number() over (partition by p.tenant_slug order by x.created_at desc, x.id desc) as position
  from assignments_t x join plans_t p on x.plan_id = p.id
  where x.valid_from >= timestamp '2024-03-01' and (x.valid_until is null or x.valid_until <= timestamp '2024-09-01')
) a right join (
  select p.tenant_slug, count(*) as total
  from assignments_t x join plans_t p on x.plan_id = p.id
  where x.valid_from >= timestamp '2024-03-01' and (x.valid_until is null or x.valid_until <= timestamp '2024-09-01')
  group by p.tenant_slug) t on a.tenant_slug = t.tenant_slug and a.position <= 50""", PLANS, ASSIGNMENTS))
def c14_assignments_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14: assignments by validity bounds (open end counts as below any
    upper bound), first 50 per tenant, newest first, with total."""
    page = cat.assignments_page(fx.assignments(spark, sf_dir), fx.plans(spark, sf_dir), cat.Page(1, 50),
                                valid_from_gte=dt.datetime(2024, 3, 1), valid_until_lte=dt.datetime(2024, 9, 1))
    return page.select("id", "plan_id", "organization_id", "user_id", "valid_from", "valid_until", "created_at",
                       "tenant_slug", "position", "total")


@register("c14_assignments_with_tenant", _cat_sql("""
select x.id, x.plan_id, x.organization_id, x.user_id, x.valid_from, x.valid_until, p.tenant_slug
from assignments_t x join plans_t p on x.plan_id = p.id""", PLANS, ASSIGNMENTS))
def c14_assignments_with_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14 unpaged: every assignment whose plan exists, with the plan's tenant."""
    return cat.assignments_of(fx.assignments(spark, sf_dir), fx.plans(spark, sf_dir)) \
        .select("id", "plan_id", "organization_id", "user_id", "valid_from", "valid_until", "tenant_slug")


@register("c15_active_assignments_page", _cat_sql("""
select a.id, a.plan_id, a.created_at, t.tenant_slug, a.position, t.total from (
  select x.*, p.tenant_slug,
         row_number() over (partition by p.tenant_slug order by x.created_at desc, x.id desc) as position
  from assignments_t x join plans_t p on x.plan_id = p.id where p.archived_at is null) a
right join (select p.tenant_slug, count(*) as total from assignments_t x join plans_t p on x.plan_id = p.id
      where p.archived_at is null group by p.tenant_slug) t
  on a.tenant_slug = t.tenant_slug and a.position between 51 and 75""", PLANS, ASSIGNMENTS))
def c15_active_assignments_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 3 (limit 25) of assignments to non-archived plans per tenant."""
    page = cat.active_assignments_page(fx.assignments(spark, sf_dir), fx.plans(spark, sf_dir), cat.Page(3, 25))
    return page.select("id", "plan_id", "created_at", "tenant_slug", "position", "total")


@register("c16_history_page", _cat_sql("""
select h.id, h.action, h.plan_id, h.valid_from, h.valid_until, h.created_at, t.tenant_slug, h.position, t.total
from (select x.*, p.tenant_slug,
             row_number() over (partition by p.tenant_slug order by x.created_at asc, x.id asc) as position
      from history_t x join plans_t p on x.plan_id = p.id
      where x.action = 'UPDATE' and x.valid_from >= timestamp '1996-01-01' and x.valid_from < timestamp '2000-01-01'
        and (x.valid_until is null or x.valid_until < timestamp '1999-06-01')) h
right join (select p.tenant_slug, count(*) as total from history_t x join plans_t p on x.plan_id = p.id
      where x.action = 'UPDATE' and x.valid_from >= timestamp '1996-01-01' and x.valid_from < timestamp '2000-01-01'
        and (x.valid_until is null or x.valid_until < timestamp '1999-06-01')
      group by p.tenant_slug) t on h.tenant_slug = t.tenant_slug and h.position between 101 and 200""", PLANS, HISTORY))
def c16_history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 2 (limit 100) of UPDATE history rows in a validity window,
    oldest first, per tenant, with total."""
    page = cat.history_page(fx.assignment_history(spark, sf_dir), fx.plans(spark, sf_dir), cat.Page(2, 100),
                            action="UPDATE", valid_from_after=dt.datetime(1996, 1, 1),
                            valid_from_before=dt.datetime(2000, 1, 1), valid_until_before=dt.datetime(1999, 6, 1))
    return page.select("id", "action", "plan_id", "valid_from", "valid_until", "created_at", "tenant_slug",
                       "position", "total")


@register("c16_deep_history_page", _cat_sql("""
select h.id, h.action, h.plan_id, h.created_at, t.tenant_slug, h.position, t.total
from (select x.*, p.tenant_slug,
             row_number() over (partition by p.tenant_slug order by x.created_at asc, x.id asc) as position
      from history_t x join plans_t p on x.plan_id = p.id) h
right join (select p.tenant_slug, count(*) as total from history_t x join plans_t p on x.plan_id = p.id
      group by p.tenant_slug) t on h.tenant_slug = t.tenant_slug and h.position between 581 and 600""", PLANS, HISTORY))
def c16_deep_history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 30 (limit 20) of the whole history, oldest first, per
    tenant, with total, by counts per sampled range."""
    plans = fx.plans(spark, sf_dir).select(F.col("id").alias("plan_id"), "tenant_slug")
    history = fx.assignment_history(spark, sf_dir).join(plans, "plan_id")
    page = cat.deep_page_with_total(history, ["tenant_slug"], cat.oldest_first(), cat.Page(30, 20))
    return page.select("id", "action", "plan_id", "created_at", "tenant_slug", "position", "total")


@register("c22_cascade_archived_plans", _cat_sql("""
select 'plan' as entity, id from plans_t where archived_at is not null
union all
select 'plan_feature', pf.id from plan_features_t pf join plans_t p on pf.plan_id = p.id where p.archived_at is not null
union all
select 'quota', q.id from quotas_t q join plan_features_t pf on q.plan_feature_id = pf.id
  join plans_t p on pf.plan_id = p.id where p.archived_at is not null
union all
select 'assignment', a.id from assignments_t a join plans_t p on a.plan_id = p.id where p.archived_at is not null""",
                                                  PLANS, FEATURES, LINKS, PLAN_FEATURES, QUOTAS, ASSIGNMENTS))
def c22_cascade_archived_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows a delete of every archived plan would cascade to."""
    plans = fx.plans(spark, sf_dir)
    return cat.cascade_delete(plans, fx.features(spark, sf_dir), fx.plan_features(spark, sf_dir),
                              fx.quotas(spark, sf_dir), fx.assignments(spark, sf_dir),
                              deleted_plans=plans.where(F.col("archived_at").isNotNull()))


@register("c22_deleted_features", _cat_sql("""
select 'feature' as entity, id from features_t where type = 'static'
union all
select 'plan_feature', pf.id from plan_features_t pf left join features_t f on pf.feature_id = f.id
  where f.id is null or f.type = 'static' or pf.plan_id = 'plan_3'
union all
select 'quota', q.id from quotas_t q left join plan_features_t pf on q.plan_feature_id = pf.id
  left join features_t f on pf.feature_id = f.id where f.id is null or f.type = 'static' or pf.plan_id = 'plan_3'
union all
select 'assignment', a.id from assignments_t a where a.plan_id = 'plan_3'""",
                                                  PLANS, FEATURES, LINKS, PLAN_FEATURES, QUOTAS, ASSIGNMENTS))
def c22_deleted_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows a delete of every static feature would cascade to, with the
    orphans of a plan that is already gone."""
    plans, features = fx.plans(spark, sf_dir).where("id <> 'plan_3'"), fx.features(spark, sf_dir)
    return cat.cascade_delete(plans, features, fx.plan_features(spark, sf_dir), fx.quotas(spark, sf_dir),
                              fx.assignments(spark, sf_dir), deleted_features=features.where("type = 'static'"))


@register("c08_config_json", _cat_sql("""
select pf.id as plan_feature_id, case when pf.config is null then null else true end as visible
from plan_features_t pf join features_t f on pf.feature_id = f.id join plans_t p on pf.plan_id = p.id""",
                                        PLANS, FEATURES, LINKS, PLAN_FEATURES))
def c08_config_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The config text read as JSON, null where there is none."""
    pf = fx.plan_features(spark, sf_dir)
    listing = cat.plan_features_listing(pf, fx.features(spark, sf_dir), fx.plans(spark, sf_dir))
    return listing.select("plan_feature_id", F.try_variant_get("config_json", "$.visible", "boolean").alias("visible"))


# ----------------------------------------------------- assignment changes ---


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chg.apply_changes(fx.assignments(spark, sf_dir), fx.assignment_changes(spark, sf_dir),
                             fx.plans(spark, sf_dir))


def _walk_sql(body: str) -> str:
    return "with recursive " + with_views(body, TENANTS, PLANS, ASSIGNMENTS, CHANGES, CHANGE_WALK)[len("with "):]


@register("c17_assignment_history", _walk_sql("""
select concat('h_', change_id) as id, action, h_aid as assignment_id, h_pid as plan_id,
       h_oid as organization_id, h_uid as user_id, h_vf as valid_from, h_vu as valid_until, h_at as created_at
from walk where outcome = 'applied'"""))
def c17_assignment_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C17: history images of the applied changes."""
    return chg.history_rows(_folded(spark, sf_dir))


@register("c18_assignments_after_changes", _walk_sql("""
select aid as id, pid as plan_id, oid as organization_id, uid as user_id, vf as valid_from, vu as valid_until,
       ca as created_at, ua as updated_at
from walk w
where ex and rn = (select max(rn) from walk w2 where w2.key = w.key)"""))
def c18_assignments_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments after applying the change batch in order."""
    return chg.final_assignments(_folded(spark, sf_dir))


def _number(c: F.Column) -> F.Column:
    return F.regexp_extract(c, r"(\d+)$", 1).cast("long")


def _with_separators(df: DataFrame, n: F.Column) -> DataFrame:
    even = n % 2 == 0
    return df.withColumns({
        "plan_id": F.when(even, "p").otherwise("p|k"),
        "organization_id": F.concat(F.when(even, "k|").otherwise(""), F.floor(n / 2).cast("string")),
        "user_id": F.lit(None).cast("string")})


_FINAL_WALK = """
select aid as id, pid as plan_id, oid as organization_id, uid as user_id, vf as valid_from, vu as valid_until,
       ca as created_at, ua as updated_at
from walk w
where ex and rn = (select max(rn) from walk w2 where w2.key = w.key)"""


@register("c18_keys_with_separators", "with recursive " + with_views(
    _FINAL_WALK, *SEPARATOR_VIEWS, CHANGE_WALK)[len("with "):])
def c18_keys_with_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that only differ in where a separator stands stay apart."""
    current = fx.assignments(spark, sf_dir)
    current = _with_separators(current, _number(F.col("id")))
    changes = fx.assignment_changes(spark, sf_dir)
    changes = _with_separators(changes, _number(F.coalesce("organization_id", "user_id")))
    plans = fx.plans(spark, sf_dir).limit(0).select("id", "archived_at").unionByName(
        spark.sql("select explode(array('p', 'p|k')) as id, cast(null as timestamp) as archived_at"))
    return chg.final_assignments(chg.apply_changes(current, changes, plans))


@register("c18_duplicate_state", "with recursive " + with_views(
    _FINAL_WALK + """
union all
select id, plan_id, organization_id, user_id, valid_from, valid_until, created_at, created_at from older""",
    TENANTS, PLANS, *DOUBLED_VIEWS, CHANGE_WALK)[len("with "):])
def c18_duplicate_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two current rows with one key, changes apply to the newer; the
    older one passes through."""
    current = fx.assignments(spark, sf_dir)
    n = _number(F.col("id"))
    doubles = current.where(n % 10 == 0).withColumns({
        "id": F.concat(F.lit("dup_"), n.cast("string")), "created_at": F.col("created_at") + F.expr("interval 1 second")})
    return chg.final_assignments(chg.apply_changes(
        current.unionByName(doubles), fx.assignment_changes(spark, sf_dir), fx.plans(spark, sf_dir)))


@register("c19_change_outcomes", _walk_sql("""
select change_id, action, outcome, reason from walk where rn > 0"""))
def c19_change_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C19 (+C20, C21 on creates): applied / no_op / rejected per change."""
    return chg.change_outcomes(_folded(spark, sf_dir))


@register("c20_archived_plan_rejects", with_views("""
select c.change_id, c.plan_id, 'plan_archived' as reason
from changes_t c join plans_t p on c.plan_id = p.id
where c.action = 'CREATE' and p.archived_at is not null""", TENANTS, PLANS, CHANGES))
def c20_archived_plan_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C20: create requests naming an archived plan."""
    creates = fx.assignment_changes(spark, sf_dir).where(F.col("action") == "CREATE")
    return cat.archived_plan_rejects(creates, fx.plans(spark, sf_dir)).select("change_id", "plan_id", "reason")


@register("c21_assignment_violations", with_views("""
select id, plan_id, violation from (
  select r.id, r.plan_id, unnest([
    case when (r.organization_id is not null) = (r.user_id is not null) then 'not_exactly_one_entity' end,
    case when r.valid_until is not null and r.valid_from > r.valid_until then 'valid_from_after_valid_until' end,
    case when r.organization_id is not null and (select count(*) from requests r2
         where r2.plan_id = r.plan_id and r2.organization_id = r.organization_id) > 1
         then 'duplicate_plan_organization' end,
    case when r.user_id is not null and (select count(*) from requests r2
         where r2.plan_id = r.plan_id and r2.user_id = r.user_id) > 1
         then 'duplicate_plan_user' end]) as violation
  from requests r) where violation is not null""", CHANGES,
    "requests as (select change_id as id, plan_id, organization_id, user_id, valid_from, valid_until "
    "from changes_t where action = 'CREATE')"))
def c21_assignment_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create requests checked as assignment rows (entity, range, unique)."""
    creates = (fx.assignment_changes(spark, sf_dir).where(F.col("action") == "CREATE")
               .select(F.col("change_id").alias("id"), "plan_id", "organization_id", "user_id",
                       "valid_from", "valid_until"))
    return cat.assignment_violations(creates)


# ------------------------------------------------------------ many meters ---


_LONG_SQL_PART = """
select 'default' as tenant_slug, '{meter}' as meter, ws as windowstart, we as windowend, organization, "user",
       page as dims, {uniq} as uniq_v,
       round(sum({num}), 2) as sum_v, count({num}) as cnt_num,
       count(*) as cnt_all, min({num}) as min_v, max({num}) as max_v
from metered where type = '{type}'
group by ws, we, organization, "user", page{extra}"""


@register("m05_registry_partials", _sql(" union all ".join([
    _LONG_SQL_PART.format(meter="purchase_amount", type="app.purchase", uniq="cast(null as varchar)",
                          num="amount", extra=""),
    _LONG_SQL_PART.format(meter="clicks", type="app.click", uniq="cast(null as varchar)",
                          num="cast(null as double)", extra=""),
    _LONG_SQL_PART.format(meter="click_unique_k", type="app.click", uniq="k", num="cast(null as double)",
                          extra=", k"),
])))
def m05_registry_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1-M11 for a registry: three meters' partials from one pass over events."""
    long = long_partials(usage_events(spark, sf_dir), [SUM_PURCHASE, COUNT_CLICKS, UNIQUE_CLICK_K])
    return rounded(long.withColumn("dims", F.array_join("dims", "|")), "sum_v").drop("uniq_hll")


def _of_page(aggregation: str, value: str | None, slug: str, event_type: str = "app.purchase") -> MeterSpec:
    return MeterSpec(slug, event_type, aggregation, value, ("page",))


SIX = (_of_page("sum", "amount", "six_sum"), _of_page("avg", "amount", "six_avg"), _of_page("min", "amount", "six_min"),
       _of_page("max", "amount", "six_max"), _of_page("count", None, "six_count"),
       _of_page("unique_count", "k", "six_unique"))


@register("m05_six_aggregations", _sql(" union all ".join(
    _LONG_SQL_PART.format(meter=s.slug, type=s.event_type,
                          uniq="k" if s.aggregation == "unique_count" else "cast(null as varchar)",
                          num="amount" if s.value_property == "amount" else "cast(null as double)",
                          extra=", k" if s.aggregation == "unique_count" else "") for s in SIX)))
def m05_six_aggregations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meters of all six aggregations over one type and its dimensions,
    from two sub-aggregates (numbers, distinct values)."""
    long = long_partials(usage_events(spark, sf_dir), SIX)
    return rounded(long.withColumn("dims", F.array_join("dims", "|")), "sum_v").drop("uniq_hll")


@register("l01_event_types", """
select distinct event_type from (
  select case event_id % 50 when 7 then '' when 11 then 'unknown.type' else concat('app.', event_type) end
         as event_type
  from events) where event_type <> ''""")
def l01_event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: the non-empty event types of the dirty batch."""
    return ingest.distinct_event_types(dirty_raw_events(spark, sf_dir))


@register("l02_meters_for_types", """
with types as (select distinct concat('app.', event_type) as event_type from events)
select concat(event_type, '.sum') as slug, event_type, 'sum' as aggregation from types
union all
select concat(event_type, '.unique_count'), event_type, 'unique_count' from types""")
def l02_meters_for_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: the tenant's meters whose type occurs in the batch (semi-join)."""
    types = ingest.distinct_event_types(dirty_raw_events(spark, sf_dir))
    found = ingest.meters_for_types(dirty_meters(spark, sf_dir), types, tenant=DIRTY_TENANT)
    return found.select("slug", "event_type", "aggregation")


@register("c04_meters_page_one_tenant", _cat_sql("""
select id, slug, tenant_slug, created_at from meters_t where tenant_slug = 'asia'
order by created_at desc, id desc limit 25 offset 50""", METERS))
def c04_meters_page_one_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4 as the reference serves it: one tenant's page 3 (limit 25), as an
    ordered top-k with offset."""
    meters = fx.meters(spark, sf_dir).where(F.col("tenant_slug") == "asia")
    return cat.page_of(meters, cat.newest_first(), cat.Page(3, 25)).select("id", "slug", "tenant_slug",
                                                                             "created_at")
