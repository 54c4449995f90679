"""Hot keys: a third of all rows on one organization/user, one tenant, one assignment key."""

import datetime as dt

from pyspark.sql import functions as F

from meterkit.operators import changes as chg
from meterkit.operators.query import query_events, query_rollup
from meterkit.operators.rollup import minute_partials
from meterkit.plans.spec import MeterQuery, MeterSpec
from meterkit.sources import catalog as fx
from meterkit.sources.fixtures import usage_events

from conftest import SF_CHECK


def hot(events):
    third = F.abs(F.hash("id")) % 3 == 0
    return (events.withColumn("organization", F.when(third, F.lit("org_hot")).otherwise(F.col("organization")))
            .withColumn("user", F.when(third, F.lit("usr_hot")).otherwise(F.col("user"))))


def test_hot_pair_is_exact_and_pre_aggregated(spark):
    events = hot(usage_events(spark, SF_CHECK))
    q = MeterQuery(None, group_by=("organization", "user"))
    for spec in (MeterSpec("u", "app.click", "unique_count", "k", ("page",)),
                 MeterSpec("s", "app.purchase", "sum", "amount", ("page",))):
        merged = query_rollup(minute_partials(events, spec), spec, q)
        direct = query_events(events, spec, q)
        got = {(r.organization, r.user): round(r.value, 6) for r in merged.collect()}
        exp = {(r.organization, r.user): round(r.value, 6) for r in direct.collect()}
        assert got == exp and ("org_hot", "usr_hot") in got
        lines = merged._jdf.queryExecution().executedPlan().toString().splitlines()
        fed = [lines[i + 1] for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
        # every exchange is fed by a partial aggregate, so a hot group ships one row per task
        assert fed and all("HashAggregate(" in line for line in fed)
    uniq = MeterSpec("u", "app.click", "unique_count", "k", ("page",))
    day = MeterQuery("day", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 31), group_by=("organization",))
    out = query_rollup(minute_partials(events, uniq), uniq, day).where("organization = 'org_hot'").collect()
    assert out and all(r.value <= 100 for r in out)


def test_hot_assignment_key_streams_through_fold(spark):
    changes = fx.assignment_changes(spark, SF_CHECK).withColumn("plan_id", F.lit("plan_1")) \
        .withColumn("organization_id", F.lit("org_hot")).withColumn("user_id", F.lit(None).cast("string"))
    folded = chg.apply_changes(fx.assignments(spark, SF_CHECK), changes, fx.plans(spark, SF_CHECK), num_partitions=8)
    outcomes = chg.change_outcomes(folded)
    assert outcomes.count() == changes.count()
    live = chg.final_assignments(folded).where("organization_id = 'org_hot'").count()
    assert live <= 1


def hot_key(changes):
    return (changes.withColumn("plan_id", F.lit("plan_1")).withColumn("organization_id", F.lit("org_hot"))
            .withColumn("user_id", F.lit(None).cast("string")))


def test_hot_assignment_key_without_deletes_is_folded_by_several_tasks(spark):
    """Nothing cuts the changes of this key: blocks are probed from guessed
    entry states and folded from the true ones."""
    changes = hot_key(fx.assignment_changes(spark, SF_CHECK).where("action <> 'DELETE'"))
    n = changes.count()
    blocks, _ = chg.fold_blocks(fx.assignments(spark, SF_CHECK), changes, fx.plans(spark, SF_CHECK), 8)
    sizes = [r["count"] for r in blocks.where("kind in ('outcome', 'open') and action <> 'END'")
             .groupBy("block").count().collect()]
    assert sum(sizes) == n and len(sizes) > 4 and max(sizes) < n / 2


def test_untouched_state_bypasses_python(spark):
    """Assignments that no change names are not shuffled to the fold."""
    current, plans = fx.assignments(spark, SF_CHECK), fx.plans(spark, SF_CHECK)
    few = fx.assignment_changes(spark, SF_CHECK).limit(3).cache()
    folded = chg.apply_changes(current, few, plans)
    assert chg.change_outcomes(folded).count() == few.count()
    assert abs(chg.final_assignments(folded).count() - current.count()) <= 3
    blocks, untouched = chg.fold_blocks(current, few, plans, 4)
    assert blocks.count() <= 3 + 3 + 3 * 4  # changes, their states, borders
    plan = untouched._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "InArrow" not in plan
