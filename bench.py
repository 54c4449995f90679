"""Benchmark: headline rollup and ingest jobs at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Timed steps (each forces full evaluation; outputs go to the noop sink or to
Parquet in a fresh scratch folder):

* ``rollup_build_<agg>``: minute partials of one meter per aggregation,
  written as a rollup batch (M1-M13); ``rollup_build_all_six_one_pass``: the
  same six meters from one scan (``operators.multi``);
* ``query_day_rollup`` / ``query_day_events``: the same day-by-organization
  query merged from the stored rollup vs. computed from events (Q3);
* ``validate_ingest``: validation of the dirty event fixture (V1-V9);
* ``stream_ingest``: the Structured Streaming ingest job over the dirty events
  as 16 JSON-lines files, 8 per trigger (validate, write events and rejects,
  two meters' rollups per epoch; M14);
* every registered query of ``__spark_entry__`` (``reg_<name>``).
"""

from __future__ import annotations

import importlib
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from meterkit.checks import registered  # noqa: E402
from meterkit.checks.registered import Q_DAY_ORG  # noqa: E402
from meterkit.operators import ingest  # noqa: E402
from meterkit.operators.query import query_events, query_rollup  # noqa: E402
from meterkit.plans.spec import MeterSpec  # noqa: E402
from meterkit.session import build_session  # noqa: E402
from meterkit.sources import rollup_store as store  # noqa: E402
from meterkit.sources.fixtures import dirty_meters, dirty_raw_events, usage_events  # noqa: E402
from meterkit.streaming.ingest import file_event_source, start_ingest  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

SPECS = [
    MeterSpec("b_count", "app.click", "count", None, ("page",)),
    MeterSpec("b_sum", "app.purchase", "sum", "amount", ("page",)),
    MeterSpec("b_avg", "app.view", "avg", "amount", ("page",)),
    MeterSpec("b_min", "app.signup", "min", "amount", ("page",)),
    MeterSpec("b_max", "app.error", "max", "amount", ("page",)),
    MeterSpec("b_unique_count", "app.click", "unique_count", "k", ("page",)),
]


def timed(fn):
    start = time.perf_counter()
    out = fn()
    return time.perf_counter() - start, out


def noop(df):
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="meterkit-bench-")
    spark = build_session(
        f"local[{cpus}]", app_name="meterkit-bench", shuffle_partitions=int(cpus) * 2,
        extra={"spark.driver.memory": "16g",
               "spark.checkpoint.dir": os.path.join(scratch, "checkpoints"),
               "spark.sql.warehouse.dir": os.path.join(scratch, "warehouse")})
    spark.sparkContext.setLogLevel("ERROR")
    queries: dict[str, float] = {}
    extra: dict[str, float] = {}

    events = usage_events(spark, sf_dir)
    noop(events)  # warm-up: JIT, file listing
    event_rows = events.count()
    rollups = os.path.join(scratch, "rollups")

    rollup_rows = 0
    for spec in SPECS:
        sec, _ = timed(lambda s=spec: store.backfill(events, rollups, s))
        queries[f"rollup_build_{spec.aggregation}"] = round(sec, 3)
        rollup_rows += store.read_rollup(spark, rollups, spec).count()
    extra["rollup_rows_per_event_row"] = round(rollup_rows / max(1, event_rows * len(SPECS)), 4)
    many = [MeterSpec(s.slug + "_m", s.event_type, s.aggregation, s.value_property, s.properties) for s in SPECS]
    sec, _ = timed(lambda: store.backfill_many(spark, events, rollups, many, os.path.join(scratch, "long")))
    queries["rollup_build_all_six_one_pass"] = round(sec, 3)

    sum_spec = SPECS[1]
    rollup = store.read_rollup(spark, rollups, sum_spec)
    sec, _ = timed(lambda: noop(query_rollup(rollup, sum_spec, Q_DAY_ORG)))
    queries["query_day_rollup"] = round(sec, 3)
    sec, _ = timed(lambda: noop(query_events(events, sum_spec, Q_DAY_ORG)))
    queries["query_day_events"] = round(sec, 3)

    raw = dirty_raw_events(spark, sf_dir)
    raw_rows = raw.count()
    sec, _ = timed(lambda: noop(ingest.validate(raw, dirty_meters(spark, sf_dir), tenant="acme")))
    queries["validate_ingest"] = round(sec, 3)
    extra["validation_events_per_sec"] = round(raw_rows / max(sec, 1e-9), 1)

    # 16 JSON-lines files, 8 per trigger: two epochs, each read by 8 tasks as
    # a multi-partition topic would be
    inbox = os.path.join(scratch, "inbox")
    raw.drop("seq").select(F.to_json(F.struct("*")).alias("value")).repartition(16).write.text(inbox)
    # the registry is a small catalog table, materialised once as a deployment would hold it
    dirty_meters(spark, sf_dir).write.parquet(os.path.join(scratch, "registry"))
    meters = spark.read.parquet(os.path.join(scratch, "registry"))
    specs = [MeterSpec(r.slug, r.event_type, r.aggregation, r.value_property, tuple(r.properties),
                       tenant_slug="acme") for r in meters.where("event_type = 'app.purchase'").collect()]
    stream_dirs = {k: os.path.join(scratch, k) for k in ("s_events", "s_rejects", "s_rollups", "s_ckpt")}

    def stream():
        q = start_ingest(file_event_source(spark, inbox, max_files_per_trigger=8), meters,
                         specs, stream_dirs["s_events"], stream_dirs["s_rejects"], stream_dirs["s_rollups"],
                         stream_dirs["s_ckpt"], tenant="acme", available_now=True)
        q.awaitTermination()

    sec, _ = timed(stream)
    queries["stream_ingest"] = round(sec, 3)
    extra["stream_events_per_sec"] = round(raw_rows / max(sec, 1e-9), 1)

    for name, fn in registered.queries().items():
        sec, _ = timed(lambda f=fn: noop(f(spark, sf_dir)))
        queries[f"reg_{name}"] = round(sec, 3)

    total = round(sum(queries.values()), 3)
    # the training-data queries, where they are part of the build, beside the total
    entry = importlib.import_module("__spark_entry__")
    extra["training_data_sec"] = {}
    for name in sorted(set(entry.queries()) - set(registered.queries())):
        sec, _ = timed(lambda n=name: noop(entry.queries()[n](spark, sf_dir)))
        extra["training_data_sec"][name] = round(sec, 3)
    print(json.dumps({"metric": "total_sec", "value": total, "unit": "sec", "queries": queries,
                      "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""), "cpus": int(cpus),
                      "event_rows": event_rows, **extra}))
    spark.stop()


if __name__ == "__main__":
    main()
