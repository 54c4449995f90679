"""Request parsing and the spark-submit jobs, end to end on sf0.001."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from meterkit import jobs
from meterkit.operators.query import query_events
from meterkit.plans.requests import meter_query_from_request, meter_spec_from_request
from meterkit.plans.spec import MeterQueryError, MeterSpecError
from meterkit.sources.fixtures import usage_events

from conftest import SF_SMALL

METER = {"name": "Purchases", "slug": "purchases", "event_type": "app.purchase", "value_property": "amount",
         "properties": ["page"], "aggregation": "sum", "populate": True, "created_by": "me"}
QUERY = {"meter_slug": "purchases", "from": "2024-01-03T05:30:00Z", "to": "2024-01-20T14:00:00+02:00",
         "window_size": "day", "group_by": ["organization"], "filter_group_by": {"page": ["p1", "p2"]},
         "window_time_zone": "UTC"}


def test_request_parsing():
    spec = meter_spec_from_request(METER, "acme")
    assert (spec.slug, spec.tenant_slug, spec.value_property) == ("purchases", "acme", "amount")
    assert meter_spec_from_request({**METER, "aggregation": "count"}, "t").value_property is None
    for bad in ({**METER, "properties": []}, {**METER, "aggregation": "median"}, {**METER, "value_property": ""}):
        with pytest.raises(MeterSpecError):
            meter_spec_from_request(bad, "t")
    slug, q = meter_query_from_request(QUERY)
    assert slug == "purchases" and q.bounds() == (dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 21))
    for bad in ({**QUERY, "window_size": "week"}, {**QUERY, "from": "yesterday"}, {**QUERY, "from": "2024-01-03"},
                {k: v for k, v in QUERY.items() if k != "meter_slug"}):
        with pytest.raises(MeterQueryError):
            meter_query_from_request(bad)


def test_jobs_backfill_query_compact_drop(spark, scratch_dir):
    events_path = os.path.join(scratch_dir, "events")
    (usage_events(spark, SF_SMALL).withColumn("event_date", F.to_date("timestamp"))
     .write.partitionBy("event_date").parquet(os.path.join(events_path, "batch_id=1")))
    meter, query = os.path.join(scratch_dir, "m.json"), os.path.join(scratch_dir, "q.json")
    json.dump(METER, open(meter, "w"))
    json.dump(QUERY, open(query, "w"))
    root, out = os.path.join(scratch_dir, "rollups"), os.path.join(scratch_dir, "out")
    common = ["--rollup-root", root, "--meter", meter, "--tenant", "acme"]
    assert jobs.run(["backfill", *common, "--events", events_path], spark) == 0
    jobs.run(["query", *common, "--query", query, "--out", out], spark)
    rows = {(r.windowstart, r.organization): round(r.value, 6) for r in spark.read.parquet(f"{out}/rows").collect()}
    spec = meter_spec_from_request(METER, "acme")
    _, q = meter_query_from_request(QUERY)
    exp = {(r.windowstart, r.organization): round(r.value, 6) for r in query_events(usage_events(spark, SF_SMALL),
                                                                                       spec, q).collect()}
    assert rows == exp and rows
    rng = spark.read.parquet(f"{out}/range").first()
    latest_end = max(r.windowend for r in spark.read.parquet(f"{out}/rows").collect())
    assert rng.window_start == dt.datetime(2024, 1, 3, 5, 30)
    assert rng.window_end == min(latest_end, dt.datetime(2024, 1, 20, 12))
    jobs.run(["compact", *common, "--full"], spark)
    jobs.run(["drop", *common], spark)
    assert not os.path.exists(os.path.join(root, "tenant=acme", "meter=purchases"))


def test_jobs_ingest_available_now(spark, scratch_dir):
    from meterkit.sources.fixtures import dirty_raw_events
    inbox = os.path.join(scratch_dir, "inbox")
    (dirty_raw_events(spark, SF_SMALL).drop("seq").select(F.to_json(F.struct("*")).alias("value"))
     .repartition(2).write.text(inbox))
    registry = os.path.join(scratch_dir, "meters.json")
    with open(registry, "w") as fh:
        for agg, vp in (("sum", "amount"), ("unique_count", "k")):
            fh.write(json.dumps({"slug": f"purchase_{agg}", "event_type": "app.purchase", "aggregation": agg,
                                 "value_property": vp, "properties": ["page"], "tenant_slug": "acme"}) + "\n")
    paths = {k: os.path.join(scratch_dir, k) for k in ("events", "rejects", "rollups", "ckpt")}
    assert jobs.run(["ingest", "--source", inbox, "--meters", registry, "--tenant", "acme",
                     "--events-path", paths["events"], "--rejects-path", paths["rejects"],
                     "--rollup-root", paths["rollups"], "--checkpoint", paths["ckpt"], "--available-now"],
                    spark) == 0
    total = dirty_raw_events(spark, SF_SMALL).count()
    stored, rejected = spark.read.parquet(paths["events"]).count(), spark.read.parquet(paths["rejects"]).count()
    assert stored + rejected == total and rejected > 0
    jobs.run(["compact", "--rollup-root", paths["rollups"], "--tenant", "acme", "--meters", registry], spark)
    assert os.path.isdir(os.path.join(paths["rollups"], "tenant=acme", "meter=purchase_sum"))
    for bad in (["--source", inbox], ["--kafka", "h:1", "--topic", "t", "--tenant", "acme"], ["--tenant", "acme"]):
        with pytest.raises(SystemExit):
            jobs.run(["ingest", *bad, "--meters", registry, "--events-path", "e", "--rejects-path", "r", "--rollup-root", "o",
                      "--checkpoint", "c"], spark)


def test_jobs_changes(spark, scratch_dir):
    from meterkit.sources import assignments_store as st
    from meterkit.sources import catalog as fx
    st.write_initial_state(fx.assignments(spark, SF_SMALL), scratch_dir + "/state")
    fx.plans(spark, SF_SMALL).write.parquet(scratch_dir + "/plans")
    changes = scratch_dir + "/changes.json"
    with open(changes, "w") as fh:
        fh.write(json.dumps({"change_id": "x1", "seq": 1, "action": "DELETE", "plan_id": "plan_8",
                             "organization_id": "org_0", "requested_at": "2024-02-01T00:00:00Z"}) + "\n")
        fh.write(json.dumps({"change_id": "x2", "seq": 2, "action": "CREATE", "plan_id": "plan_8",
                             "organization_id": "org_0", "valid_from": "2024-03-01T00:00:00Z",
                             "requested_at": "2024-02-02T00:00:00Z"}) + "\n")
    jobs.run(["changes", "--changes", changes, "--plans", scratch_dir + "/plans", "--state", scratch_dir + "/state",
              "--history", scratch_dir + "/history", "--outcomes", scratch_dir + "/outcomes", "--batch-id", "1"],
             spark)
    out = {r.change_id: (r.outcome, r.reason) for r in spark.read.parquet(scratch_dir + "/outcomes").collect()}
    assert out["x2"][0] in ("applied", "rejected") and set(out) == {"x1", "x2"}
    before = fx.assignments(spark, SF_SMALL).count()
    after = st.read_state(spark, scratch_dir + "/state").count()
    assert after - before == (out["x2"][0] == "applied") - (out["x1"][0] == "applied")
    # only the buckets of changed keys are written, and a replay changes nothing
    written = [b for b in os.listdir(scratch_dir + "/state/version=1") if b.startswith("bucket=")]
    assert len(written) <= 1
    once = sorted(map(str, st.read_state(spark, scratch_dir + "/state").collect()))
    jobs.run(["changes", "--changes", changes, "--plans", scratch_dir + "/plans", "--state", scratch_dir + "/state",
              "--history", scratch_dir + "/history", "--outcomes", scratch_dir + "/outcomes", "--batch-id", "1"], spark)
    assert sorted(map(str, st.read_state(spark, scratch_dir + "/state").collect())) == once
    st.prune_versions(spark, scratch_dir + "/state", 1)
    assert sorted(map(str, st.read_state(spark, scratch_dir + "/state").collect())) == once
