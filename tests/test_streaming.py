"""Streaming ingest with late files, replay and compaction."""

import dataclasses
import datetime as dt
import os

from pyspark.sql import functions as F

from meterkit.operators.query import query_events, query_rollup
from meterkit.plans.spec import MeterQuery, MeterSpec
from meterkit.sources import rollup_store as store
from meterkit.sources.fixtures import dirty_meters, usage_events
from meterkit.streaming.ingest import file_event_source, process_batch, read_rejects, run_of, start_ingest

from conftest import SF_SMALL

SUM = MeterSpec("purchase_amount", "app.purchase", "sum", "amount", ("page",), tenant_slug="acme")
UNIQ = MeterSpec("click_k", "app.click", "unique_count", "k", ("page",), tenant_slug="acme")
Q = MeterQuery("hour", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 31), group_by=("organization",))


def rows(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def _write_event_files(events, folder):
    """Four JSON-lines files by hash of the id, each spanning the month."""
    lines = events.select(F.to_json(F.struct(
        "id", "type", "source", "organization", "user",
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "properties")).alias("value"))
    for i in range(4):
        part = lines.where(F.abs(F.hash("value")) % 4 == i)
        part.coalesce(1).write.mode("overwrite").text(os.path.join(folder, f"staging_{i}"))
    return [os.path.join(folder, f"staging_{i}") for i in range(4)]


def test_stream_equals_batch_and_replay_is_idempotent(spark, scratch_dir):
    events = usage_events(spark, SF_SMALL)
    meters = dirty_meters(spark, SF_SMALL)
    staging = _write_event_files(events, scratch_dir)
    inbox = os.path.join(scratch_dir, "inbox")
    os.makedirs(inbox)
    for i, folder in enumerate(staging):
        src = [f for f in os.listdir(folder) if f.endswith(".txt")][0]
        os.link(os.path.join(folder, src), os.path.join(inbox, f"events_{i}.json"))

    paths = {k: os.path.join(scratch_dir, k) for k in ("events", "rejects", "rollups", "ckpt")}
    source = file_event_source(spark, inbox, max_files_per_trigger=1)
    query = start_ingest(source, meters, [SUM, UNIQ], paths["events"], paths["rejects"], paths["rollups"],
                         paths["ckpt"], tenant="acme", available_now=True)
    query.awaitTermination(600)
    assert query.exception() is None
    run = run_of(spark, paths["ckpt"])
    assert sorted(store.list_batches(spark, store.epochs_root(paths["rollups"]))) == [f"{run}-{n}" for n in range(1, 5)]

    for spec in (SUM, UNIQ):
        rollup = store.read_rollup(spark, paths["rollups"], spec)
        assert rows(query_rollup(rollup, spec, Q)) == rows(query_events(events, spec, Q))

    stored = spark.read.parquet(paths["events"])
    assert stored.count() == events.count()
    from meterkit.sources.events import read_events
    window = read_events(spark, paths["events"], dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 5), "app.purchase")
    expected = events.where("type = 'app.purchase' and timestamp >= '2024-01-03' and timestamp < '2024-01-05'")
    assert window.count() == expected.count() > 0
    assert "PartitionFilters: [isnotnull(event_date" in window._jdf.queryExecution().executedPlan().toString()
    assert read_rejects(spark, paths["rejects"], "acme").count() == 0

    # Replaying epoch 1 with the same input rewrites batch 2 instead of adding to it.
    before = rows(query_rollup(store.read_rollup(spark, paths["rollups"], SUM), SUM, Q))
    replay = spark.read.text(os.path.join(inbox, "events_1.json"))
    from meterkit.streaming.ingest import parse_event_lines
    counts = process_batch(parse_event_lines(replay), 1, meters, [SUM], paths["events"], paths["rejects"],
                           paths["rollups"], tenant="acme", run=run)
    assert counts["events"] == replay.count() and counts["rejected"] == 0
    assert rows(query_rollup(store.read_rollup(spark, paths["rollups"], SUM), SUM, Q)) == before

    # Compaction keeps results and leaves one batch behind.
    store.compact(spark, paths["rollups"], SUM)
    assert store.list_batches(spark, store.meter_root(paths["rollups"], SUM)) == ["c1-4"]
    assert rows(query_rollup(store.read_rollup(spark, paths["rollups"], SUM), SUM, Q)) == before
    # epochs stay until every meter's layers cover them
    assert store.prune_epochs(spark, paths["rollups"], [SUM, UNIQ]) == []
    expected = rows(query_rollup(store.read_rollup(spark, paths["rollups"], UNIQ), UNIQ, Q))
    assert len(store.compact_all(spark, paths["rollups"], [SUM, UNIQ])) == 1
    assert store.list_batches(spark, store.epochs_root(paths["rollups"])) == []
    assert rows(query_rollup(store.read_rollup(spark, paths["rollups"], UNIQ), UNIQ, Q)) == expected

    assert store.drop_rollup(spark, paths["rollups"], SUM)
    assert store.read_rollup(spark, paths["rollups"], SUM).count() == 0


def test_backfill_then_partition_pruning(spark, scratch_dir):
    events = usage_events(spark, SF_SMALL)
    store.backfill(events, scratch_dir, SUM)
    rollup = store.read_rollup(spark, scratch_dir, SUM)
    q = MeterQuery("day", dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 5))
    result = query_rollup(rollup, SUM, q)
    assert rows(result) == rows(query_events(events, SUM, q))
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "window_date" in plan
    assert store.backfill(events, scratch_dir, MeterSpec("x", "t", "count", None, ("p",), populate=False)) is None


def test_crash_between_compaction_steps_does_not_double_count(spark, scratch_dir):
    events = usage_events(spark, SF_SMALL)
    from meterkit.operators.rollup import compact_partials, minute_partials
    halves = [events.where(F.col("source") == s) for s in ("web_api", "mobile_api")]
    for i, h in enumerate(halves):
        store.write_epoch(minute_partials(h, SUM), scratch_dir, SUM, i)
    expected = rows(query_rollup(store.read_rollup(spark, scratch_dir, SUM), SUM, Q))
    # compaction output written, but not committed
    base = store.meter_root(scratch_dir, SUM)
    merged = compact_partials(store.read_rollup(spark, scratch_dir, SUM).drop("batch_id"), SUM)
    merged.write.partitionBy("window_date").parquet(os.path.join(base, "batch_id=c1-2", "attempt=lost"))
    assert sorted(store.list_batches(spark, base)) == ["1", "2"]
    assert rows(query_rollup(store.read_rollup(spark, scratch_dir, SUM), SUM, Q)) == expected
    # and the other way: committed, with what it replaced still on disk
    store.write_batch(merged, scratch_dir, SUM, "c1-2")
    assert store.list_batches(spark, base) == ["c1-2"] and os.path.isdir(os.path.join(base, "batch_id=1"))
    assert rows(query_rollup(store.read_rollup(spark, scratch_dir, SUM), SUM, Q)) == expected
    assert store.write_epoch(minute_partials(halves[0], SUM), scratch_dir, SUM, 0) is None  # a replay of what is folded
    assert rows(query_rollup(store.read_rollup(spark, scratch_dir, SUM), SUM, Q)) == expected


def test_kafka_records_and_event_types(spark):
    from meterkit.operators.ingest import distinct_event_types
    from meterkit.streaming.ingest import kafka_records
    valid = spark.createDataFrame([("e1", "api.sum", "", "org1", "u1", "2024-01-01 00:00:00", '{"a":1}')],
                                  "id string, type string, source string, organization string, user string, "
                                  "timestamp string, properties string")
    [rec] = kafka_records(valid).collect()
    assert rec.key == "org1-u1"
    assert '"type":"api.sum"' in rec.value and '"properties":"{\\"a\\":1}"' in rec.value
    assert rec.headers[0].key == "content-type" and bytes(rec.headers[0].value) == b"application/json"
    batch = spark.createDataFrame([("a",), ("",), ("a",), ("b",)], "type string")
    assert sorted(r.event_type for r in distinct_event_types(batch).collect()) == ["a", "b"]


def test_layered_compaction_and_uncommitted_batches(spark, scratch_dir):
    from meterkit.operators.rollup import minute_partials
    events = usage_events(spark, SF_SMALL)
    quarters = [events.where(F.abs(F.hash("id")) % 4 == i) for i in range(4)]
    expected = rows(query_events(events, SUM, Q))
    read = lambda: rows(query_rollup(store.read_rollup(spark, scratch_dir, SUM), SUM, Q))
    base = store.meter_root(scratch_dir, SUM)

    for i in (0, 1):
        store.write_epoch(minute_partials(quarters[i], SUM), scratch_dir, SUM, i)
    assert "batch_id=c1-2" in store.compact(spark, scratch_dir, SUM)
    for i in (2, 3):
        store.write_epoch(minute_partials(quarters[i], SUM), scratch_dir, SUM, i)
    store.compact(spark, scratch_dir, SUM)          # minor: only batches 3 and 4
    assert sorted(store.list_batches(spark, base)) == ["c1-2", "c3-4"]
    assert store.read_rollup(spark, scratch_dir, SUM).where("batch_id = 'c3-4'").count() < \
        minute_partials(events, SUM).count()
    assert read() == expected

    # a batch whose write never committed is invisible
    stray = os.path.join(base, "batch_id=5", "attempt=lost")
    minute_partials(quarters[0], SUM).write.parquet(stray)
    assert read() == expected

    store.compact(spark, scratch_dir, SUM, full=True)
    assert store.compact(spark, scratch_dir, SUM, full=True) is None   # already one layer: no self-overwrite
    assert store.compact(spark, scratch_dir, SUM) is None
    # the uncommitted batch may still be in flight: kept, still unread
    assert store.list_batches(spark, base) == ["f4"] and os.path.isdir(stray)
    assert read() == expected


def test_event_lines_nil_versus_empty(spark):
    from meterkit.operators import ingest
    from meterkit.streaming.ingest import parse_event_lines
    lines = spark.createDataFrame([("{bad",), ("[1,2]",), ("{}",), (
        '{"id":"e1","type":"app.click","organization":"o","user":"u","timestamp":"2024-01-01T00:00:00Z",'
        '"properties":{"page":"p1","k":"k1","amount":2}}',)], "value string")
    parsed = parse_event_lines(lines)
    rows = parsed.collect()
    assert [r.type for r in rows] == [None, None, "", "app.click"]
    assert rows[3].properties == '{"page":"p1","k":"k1","amount":2}'
    meters = spark.createDataFrame([("app.click", "sum", "amount", ["page"], "acme")],
                                   "event_type string, aggregation string, value_property string, "
                                   "properties array<string>, tenant_slug string")
    reasons = [r.reason for r in ingest.validate(parsed, meters, tenant="acme").collect()]
    assert reasons == ["nil_event", "nil_event", "missing_event_type", None]


def test_direct_query_prunes_event_dates(spark, scratch_dir):
    events = usage_events(spark, SF_SMALL).withColumn("event_date", F.to_date("timestamp"))
    events.write.partitionBy("event_date").parquet(scratch_dir + "/events")
    from meterkit.sources.events import read_events
    stored = read_events(spark, scratch_dir + "/events")
    q = MeterQuery("day", dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 5), group_by=("organization",))
    out = query_events(stored, SUM, q)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert rows(out) == rows(query_events(usage_events(spark, SF_SMALL), SUM, q))


def test_backfill_while_ingest_runs_never_double_counts(spark, scratch_dir):
    """A meter added mid-stream: backfill up to the last committed epoch, then
    a replay of that epoch and a new epoch arrive."""
    from meterkit.sources.fixtures import dirty_meters
    from meterkit.streaming.ingest import parse_event_lines
    events = usage_events(spark, SF_SMALL)
    lines = events.select(F.to_json(F.struct(
        "id", "type", "source", "organization", "user",
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "properties")).alias("value"))
    parts = [parse_event_lines(lines.where(F.abs(F.hash("value")) % 3 == i)) for i in range(3)]
    meters = dirty_meters(spark, SF_SMALL)
    paths = {k: os.path.join(scratch_dir, k) for k in ("events", "rejects", "rollups")}
    for epoch in (0, 1):                       # the stream runs without the new meter
        process_batch(parts[epoch], epoch, meters, [], paths["events"], paths["rejects"], paths["rollups"],
                      tenant="acme")
    assert store.backfill_from_events_table(spark, paths["events"], paths["rollups"], [SUM],
                                            scratch_dir + "/long") == "f2"
    for epoch in (1, 2):                       # replay of epoch 1, then a new epoch, with the meter
        process_batch(parts[epoch], epoch, meters, [SUM], paths["events"], paths["rejects"], paths["rollups"],
                      tenant="acme")
    got = rows(query_rollup(store.read_rollup(spark, paths["rollups"], SUM), SUM, Q))
    assert got == rows(query_events(events, SUM, Q))


def _parts(spark, n):
    from meterkit.streaming.ingest import from_queue, parse_event_lines
    lines = usage_events(spark, SF_SMALL).select(F.to_json(F.struct(
        "id", "type", "source", "organization", "user",
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "properties")).alias("value"))
    return [from_queue(parse_event_lines(lines.where(F.abs(F.hash("value")) % n == i))) for i in range(n)]


def test_compaction_beside_the_stream(spark, scratch_dir):
    meters = dirty_meters(spark, SF_SMALL)
    paths = [os.path.join(scratch_dir, k) for k in ("events", "rejects", "rollups")]
    for epoch, part in enumerate(_parts(spark, 5)):
        process_batch(part, epoch, meters, [SUM, UNIQ], *paths, tenant="acme")
        if epoch % 2:
            store.compact_all(spark, paths[2], [SUM, UNIQ])
    for spec in (SUM, UNIQ):
        assert sorted(store.list_batches(spark, store.meter_root(paths[2], spec))) == ["c1-2", "c3-4"]
        got = rows(query_rollup(store.read_rollup(spark, paths[2], spec), spec, Q))
        assert got == rows(query_events(usage_events(spark, SF_SMALL), spec, Q))
    assert store.list_batches(spark, store.epochs_root(paths[2])) == ["5"]
    store.compact_all(spark, paths[2], [SUM], full=True)
    assert store.list_batches(spark, store.meter_root(paths[2], SUM)) == ["f5"]


def test_jobs_per_epoch_do_not_grow_with_meters(spark, scratch_dir):
    many = [MeterSpec(f"m{i}", "app.purchase", "sum", "amount", ("page",), tenant_slug="acme") for i in range(12)]
    many.append(MeterSpec("h", "app.click", "unique_count", "k", ("page",), unique_mode="hll", tenant_slug="acme"))
    [part] = _parts(spark, 1)
    meters, jobs = dirty_meters(spark, SF_SMALL), []
    for n, specs in enumerate((many[:1], many)):
        paths = [os.path.join(scratch_dir, str(n), k) for k in ("events", "rejects", "rollups")]
        spark.sparkContext.setJobGroup(f"epoch{n}", "one epoch")
        process_batch(part, 0, meters, specs, *paths, tenant="acme")
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"epoch{n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]
    exact = {(r.windowstart, r.organization): r.value for r in query_events(usage_events(spark, SF_SMALL), UNIQ, Q).collect()}
    sketched = query_rollup(store.read_rollup(spark, paths[2], many[-1]), many[-1], Q).collect()
    assert {(r.windowstart, r.organization) for r in sketched} == set(exact)
    assert all(abs(r.value - exact[r.windowstart, r.organization]) <= 0.05 * r.value + 1 for r in sketched)


def test_a_meter_registered_while_the_stream_runs(spark, scratch_dir):
    parts = _parts(spark, 2)
    paths = [os.path.join(scratch_dir, k) for k in ("events", "rejects", "rollups")]
    columns = "slug string, event_type string, aggregation string, value_property string, properties array<string>, tenant_slug string"
    first = ("clicks", "app.click", "count", None, ["page"], "acme")
    second = ("purchase_amount", "app.purchase", "sum", "amount", ["page"], "acme")
    process_batch(parts[0], 0, spark.createDataFrame([first], columns), None, *paths, tenant="acme")
    process_batch(parts[1], 1, spark.createDataFrame([first, second], columns), None, *paths, tenant="acme")
    clicks = MeterSpec("clicks", "app.click", "count", None, ("page",), tenant_slug="acme")
    assert rows(query_rollup(store.read_rollup(spark, paths[2], clicks), clicks, Q)) == rows(
        query_events(usage_events(spark, SF_SMALL), clicks, Q))
    assert store.read_rollup(spark, paths[2], SUM).count() > 0
    import pytest
    with pytest.raises(ValueError, match="tenant"):
        process_batch(parts[1], 2, spark.createDataFrame([first], columns), None, *paths, tenant="")


def test_straddled_backfill_is_not_counted_twice(spark, scratch_dir):
    """Batches 1 to 3, folded into c1-3; then a backfill that only saw 1 and 2."""
    from meterkit.operators.rollup import minute_partials
    spec = MeterSpec("s", "t", "sum", "v", ("p",))
    one = spark.createDataFrame([("t", "o", "u", dt.datetime(2024, 1, 1), '{"v":"1","p":"x"}')],
                                "type string, organization string, user string, timestamp timestamp, properties string")
    for epoch in range(3):
        store.write_epoch(minute_partials(one, spec), scratch_dir, spec, epoch)
    store.compact(spark, scratch_dir, spec)
    store.write_batch(minute_partials(one.unionAll(one), spec), scratch_dir, spec, "f2")
    total = query_rollup(store.read_rollup(spark, scratch_dir, spec), spec, MeterQuery(None)).first().value
    assert total == 3.0


def test_uncommitted_events_are_not_read(spark, scratch_dir):
    from meterkit.sources.events import read_events
    base = os.path.join(scratch_dir, "events")
    events = usage_events(spark, SF_SMALL).withColumn("event_date", F.to_date("timestamp"))
    for b in (1, 2):
        events.write.partitionBy("event_date").parquet(os.path.join(base, f"batch_id={b}"))
    assert read_events(spark, base).count() == 2 * events.count()
    os.remove(os.path.join(base, "batch_id=2", "_SUCCESS"))
    assert read_events(spark, base).count() == events.count()
    assert read_events(spark, base, batches=[2]).count() == 0


def test_queue_form_round_trip(spark):
    """Accepted events sent to the topic are accepted when read from it."""
    from meterkit.operators import ingest
    from meterkit.streaming.ingest import from_queue, kafka_records, parse_event_lines
    meters = dirty_meters(spark, SF_SMALL)
    valid = usage_events(spark, SF_SMALL)
    again = from_queue(parse_event_lines(kafka_records(valid)))
    stored = ingest.typed_events(ingest.validate(again, meters, tenant="acme"))
    assert stored.exceptAll(valid.select(*stored.columns)).count() == 0
    assert stored.count() == valid.count()


def test_empty_micro_batch(spark, scratch_dir):
    from meterkit.sources.fixtures import dirty_meters
    from meterkit.streaming.ingest import parse_event_lines
    empty = parse_event_lines(spark.createDataFrame([], "value string"))
    paths = [os.path.join(scratch_dir, k) for k in ("events", "rejects", "rollups")]
    counts = process_batch(empty, 0, dirty_meters(spark, SF_SMALL), [SUM, UNIQ], *paths, tenant="acme")
    assert counts == {"events": 0, "accepted": 0, "rejected": 0}
    assert store.read_rollup(spark, paths[2], SUM).count() == 0
    assert query_rollup(store.read_rollup(spark, paths[2], UNIQ), UNIQ, Q).count() == 0


def test_tenants_with_equal_epochs_share_a_root(spark, scratch_dir):
    """Neither a write nor a compaction of one tenant touches another's epochs."""
    events, other = usage_events(spark, SF_SMALL), dataclasses.replace(SUM, tenant_slug="other")
    halves = [events.where(F.abs(F.hash("id")) % 2 == i) for i in range(2)]
    want = [rows(query_events(part, SUM, Q)) for part in halves]
    store.write_epoch_of_all(halves[0], scratch_dir, [SUM], 0)
    store.write_epoch_of_all(halves[1], scratch_dir, [other], 0)

    def stored(spec):
        return rows(query_rollup(store.read_rollup(spark, scratch_dir, spec), spec, Q))

    assert [stored(SUM), stored(other)] == want
    store.compact_all(spark, scratch_dir, [SUM])
    assert [stored(SUM), stored(other)] == want
    store.drop_rollup(spark, scratch_dir, SUM)
    assert stored(SUM) == [] and stored(other) == want[1]


def _ingest(spark, inbox, paths, ckpt, meters, specs):
    query = start_ingest(file_event_source(spark, inbox), meters, specs, *paths, ckpt, tenant="acme", available_now=True)
    query.awaitTermination(600)
    assert query.exception() is None


def test_new_checkpoint_adds_and_loses_nothing(spark, scratch_dir):
    """A stream started with a new checkpoint on the same tables, before and
    after a compaction; then the first one goes on where it was."""
    from meterkit.sources.events import event_batches, read_events
    meters = dirty_meters(spark, SF_SMALL)
    paths = [os.path.join(scratch_dir, k) for k in ("events", "rejects", "rollups")]
    inboxes = [os.path.join(scratch_dir, f"in{i}") for i in range(2)]
    staging = _write_event_files(usage_events(spark, SF_SMALL), scratch_dir)

    def put(part, inbox):
        os.makedirs(inboxes[inbox], exist_ok=True)
        src = [f for f in os.listdir(staging[part]) if f.endswith(".txt")][0]
        os.link(os.path.join(staging[part], src), os.path.join(inboxes[inbox], f"e{part}.json"))

    for part, inbox in ((0, 0), (1, 1), (2, 0)):
        put(part, inbox)
        _ingest(spark, inboxes[inbox], paths, os.path.join(scratch_dir, f"ckpt{inbox}"), meters, [SUM])
        if part == 0:
            store.compact_all(spark, paths[2], [SUM])
    stored = read_events(spark, paths[0], tenant="acme")
    assert stored.count() == sum(spark.read.text(s).count() for s in staging[:3]) == stored.select("id").distinct().count()
    assert len({run for run, _ in event_batches(spark, paths[0], "acme")}) == 2
    assert rows(query_rollup(store.read_rollup(spark, paths[2], SUM), SUM, Q)) == rows(query_events(stored, SUM, Q))


def test_readers_keep_their_snapshot(spark, scratch_dir):
    """A reader planned before a replay, a compaction and a vacuum with grace
    answers as before; without grace its folders are gone."""
    from meterkit.operators.rollup import minute_partials
    from meterkit.sources.batch_log import BatchLog
    events = usage_events(spark, SF_SMALL)
    halves = [events.where(F.abs(F.hash("id")) % 2 == i) for i in range(2)]
    for i, half in enumerate(halves):
        store.write_epoch(minute_partials(half, SUM), scratch_dir, SUM, i)
    planned = query_rollup(store.read_rollup(spark, scratch_dir, SUM), SUM, Q)
    store.write_epoch(minute_partials(halves[1], SUM), scratch_dir, SUM, 1)
    store.compact(spark, scratch_dir, SUM)
    log = BatchLog(spark, store.meter_root(scratch_dir, SUM))
    assert log.vacuum() == [] and len(log.snapshot().dropped) == 3
    assert rows(planned) == rows(query_events(events, SUM, Q))
    assert len(log.vacuum(grace=0)) == 3 and log.snapshot().dropped == []
    assert os.listdir(os.path.join(log.base, "batch_id=1")) == []
    assert rows(query_rollup(store.read_rollup(spark, scratch_dir, SUM), SUM, Q)) == rows(query_events(events, SUM, Q))


def test_stable_ids_by_place_and_content(spark, scratch_dir):
    from meterkit.streaming.ingest import parse_event_lines, publish_once, with_stable_ids
    lines = [f'{{"id":"{i}","type":"t","organization":"o","user":"u","timestamp":"","properties":"p"}}' for i in ("", "", "own")] + ["{}", "broken"]
    placed = spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "value string, at int").repartition(2)
    raw = parse_event_lines(placed, place=F.col("at").cast("string"))
    first, again, other = (sorted(r.id or "" for r in with_stable_ids(raw, s).collect()) for s in ("a/0", "a/0", "a/1"))
    assert first == again != other and len(set(first)) == 5 and {"", "own"} <= set(first)
    plain = raw.drop("place")
    first, again = (sorted(str(tuple(r)) for r in with_stable_ids(p, "a/0").collect()) for p in (plain.repartition(4), plain.coalesce(1)))
    assert first == again and len(set(first)) == 5
    sent = []
    for _ in range(2):
        publish_once(raw, ("h", "t"), os.path.join(scratch_dir, "_published"), "r1-1", send=lambda df, *sink: sent.append(sink))
    assert sent == [("h", "t")]
