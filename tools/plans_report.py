"""Write the physical plans of the headline operators to docs/PLANS.md.

Run: python tools/plans_report.py [sf_dir]. Plans are taken from
``executedPlan`` before execution (AQE shows its initial plan), on the
driver's sf tables, with a stored rollup where the operator reads one.
"""

from __future__ import annotations

import datetime as dt
import os
import sys
import tempfile

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)

from meterkit.checks import registered as R  # noqa: E402
from meterkit.operators import catalog as cat  # noqa: E402
from meterkit.operators import changes as chg  # noqa: E402
from meterkit.operators import ingest  # noqa: E402
from meterkit.operators.multi import long_partials  # noqa: E402
from meterkit.operators.query import query_events, query_rollup  # noqa: E402
from meterkit.operators.rollup import minute_partials  # noqa: E402
from meterkit.plans.spec import MeterQuery  # noqa: E402
from meterkit.session import build_session  # noqa: E402
from meterkit.sources import catalog as fx  # noqa: E402
from meterkit.sources import rollup_store as store  # noqa: E402
from meterkit.sources.fixtures import dirty_meters, dirty_raw_events, usage_events  # noqa: E402


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=16)
    spark.sparkContext.setLogLevel("ERROR")
    root = tempfile.mkdtemp(prefix="meterkit-plans-")
    events = usage_events(spark, sf)
    store.backfill(events, root, R.SUM_PURCHASE)
    store.backfill(events, root, R.UNIQUE_CLICK_K)
    q = MeterQuery("day", dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 10), group_by=("organization",),
                   filters={"page": ["p1", "p2"]})
    sections = [
        ("Minute rollup build (sum meter)", minute_partials(events, R.SUM_PURCHASE),
         "partial_sum before the one exchange on the rollup grain; the properties are parsed once."),
        ("Meter query merged from a stored rollup (sum, day, filter)",
         query_rollup(store.read_rollup(spark, root, R.SUM_PURCHASE), R.SUM_PURCHASE, q),
         "PartitionFilters on window_date, PushedFilters for page and the window bounds, five-column ReadSchema."),
        ("Meter query merged from a stored rollup (exact unique, day)",
         query_rollup(store.read_rollup(spark, root, R.UNIQUE_CLICK_K), R.UNIQUE_CLICK_K, q),
         "two-phase distinct: partial aggregation on (group, value), then partial_count(distinct) on the group."),
        ("Same query straight from events", query_events(events, R.SUM_PURCHASE, q),
         "the raw timestamp range is pushed below the projection; a single aggregation."),
        ("Registry rollup, one pass for three meters",
         long_partials(events, [R.SUM_PURCHASE, R.COUNT_CLICKS, R.UNIQUE_CLICK_K]),
         "one scan, BroadcastHashJoin with the meter definitions, one aggregation for all meters."),
        ("Event validation", ingest.validate(dirty_raw_events(spark, sf), dirty_meters(spark, sf), tenant="acme"),
         "BroadcastHashJoin with the per-type requirements (no shuffle of events); one JSON parse per event."),
        ("Per-tenant page (page 2 of 20) with totals", cat.plans_page(fx.plans(spark, sf), cat.Page(2, 20)),
         "WindowGroupLimit Partial before the exchange, Final after it; totals from a partial count."),
        ("Quota rule check", cat.quota_violations(fx.quotas(spark, sf)),
         "duplicates from a partial count per plan-feature joined back, not a window over the key."),
        ("Assignment change fold",
         chg.apply_changes(fx.assignments(spark, sf), fx.assignment_changes(spark, sf), fx.plans(spark, sf)),
         "state of changed keys only (broadcast semi join), windows on the key, MapInPandas for keys with several changes; the rest by expressions or untouched (anti join)."),
    ]
    out = ["# Physical plans of the headline operators", "",
           f"Generated by `tools/plans_report.py` on `{os.path.basename(sf)}` (local[8], AQE on; initial plans).", ""]
    for title, df, note in sections:
        out += [f"## {title}", "", f"What to look for: {note}", "", "```", plan(df).rstrip(), "```", ""]
    with open(os.path.join(HERE, "docs", "PLANS.md"), "w") as fh:
        fh.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
