"""The events table: batches folded into layers, files chosen by type and time."""

import datetime as dt

import pytest
from meterkit.jobs import run as run_job
from meterkit.sources.batch_log import BatchLog, Cover, Entry, Overlap, label_of
from meterkit.sources.events import INDEX, _index_of, event_batches, fold_events, read_events, tenant_root
from meterkit.sources.fixtures import usage_events
from pyspark.sql import functions as F

from conftest import SF_SMALL

TENANT = "acme"
BATCHES = [("", 1), ("", 2), ("r1", 1), ("r1", 2), ("r1", 4)]


def add(spark, path, events, run, number):
    log = BatchLog(spark, tenant_root(path, TENANT))
    folder = log.attempt(label_of(run, number))
    (events.withColumn("ingested_at", F.current_timestamp()).withColumn("event_date", F.to_date("timestamp"))
     .write.partitionBy("event_date").parquet(f"{log.base}/{folder}"))
    return log.add(Entry(label_of(run, number), folder, Cover.of([(run, number)])))


@pytest.fixture()
def table(spark, tmp_path):
    events = usage_events(spark, SF_SMALL).cache()
    path = str(tmp_path / "events")
    for i, (run, number) in enumerate(BATCHES):
        add(spark, path, events.where(F.pmod(F.xxhash64("id"), F.lit(len(BATCHES))) == i), run, number)
    return path, events


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_folding_keeps_rows_batches_and_columns(spark, table):
    path, events = table
    before = read_events(spark, path).cache()
    want, by_batch = ids(before), sorted(map(tuple, before.groupBy("batch_id").count().collect()))
    assert fold_events(spark, path, TENANT) == "layer-5"
    after = read_events(spark, path)
    assert ids(after) == want and sorted(map(tuple, after.groupBy("batch_id").count().collect())) == by_batch
    assert after.columns == before.columns and after.exceptAll(before).isEmpty()
    assert event_batches(spark, path, TENANT) == sorted(BATCHES)
    for some in ([("r1", 2)], [("", 2), ("r1", 4)], [("r1", 3)]):
        labels = [label_of(*b) for b in some]
        assert ids(read_events(spark, path, batches=some, tenant=TENANT)) == ids(before.where(F.col("batch_id").isin(labels)))
    assert fold_events(spark, path, TENANT) is None
    events.unpersist(), before.unpersist()


def test_only_files_of_the_type_and_time_are_opened(spark, table):
    path, events = table
    fold_events(spark, path, TENANT)
    every = read_events(spark, path)
    start, end = dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 5)
    found = read_events(spark, path, start, end, "app.purchase")
    assert ids(found) == ids(events.where("type = 'app.purchase' and timestamp >= '2024-01-03' and timestamp < '2024-01-05'")) != []
    assert len(found.inputFiles()) < len(every.inputFiles()) / 5
    assert all("event_date=2024-01-03" in f or "event_date=2024-01-04" in f for f in found.inputFiles())
    two = read_events(spark, path, event_type=["app.purchase", "app.click"])
    assert ids(two) == ids(events.where("type in ('app.purchase', 'app.click')"))
    assert read_events(spark, path, event_type="no such type").isEmpty()


def test_index_names_each_file_by_groups_not_rows(spark, table):
    path, events = table
    fold_events(spark, path, TENANT)
    log = BatchLog(spark, tenant_root(path, TENANT))
    folder = f"{log.base}/{log.snapshot().entries[0].folder}"
    got = sorted(map(tuple, spark.read.parquet(f"{folder}/{INDEX}").select("file", "type", "first", "last", "events").collect()))
    want = {}
    for r in spark.read.parquet(folder).select("type", "timestamp", F.input_file_name().alias("f")).collect():
        want.setdefault(("/".join(r.f.split("/")[-2:]), r.type), []).append(r.timestamp)
    assert got == sorted((*key, min(at), max(at), len(at)) for key, at in want.items())
    assert sum(r[4] for r in got) == events.count()
    # a row's path is grouped by as it is; the groups' names are cut
    plan = _index_of(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    groups, rows = plan.split("Aggregate", 1)[1].split("\n", 1)
    assert "substring_index(" in groups and "file_path" in rows
    assert "substring_index(" not in rows and "regexp_extract(" not in plan


def test_later_batches_replays_and_pinned_readers(spark, table):
    path, events = table
    pinned = read_events(spark, path, tenant=TENANT)
    fold_events(spark, path, TENANT)
    assert ids(pinned) == ids(events)  # planned before, read after
    # a replay of a folded batch adds nothing; a new batch does, also one between folded ones
    assert not add(spark, path, events.where(F.pmod(F.xxhash64("id"), F.lit(len(BATCHES))) == 3), "r1", 2)
    assert add(spark, path, events.limit(10), "r1", 3)
    assert read_events(spark, path).count() == events.count() + 10
    assert fold_events(spark, path, TENANT) is None  # one batch is not worth a layer
    assert fold_events(spark, path, TENANT, full=True)
    assert read_events(spark, path).count() == events.count() + 10
    assert event_batches(spark, path) == sorted([*BATCHES, ("r1", 3)])
    log = BatchLog(spark, tenant_root(path, TENANT))
    assert len(log.snapshot().entries) == 1
    log.vacuum(grace=0)
    assert read_events(spark, path).count() == events.count() + 10


def test_of_two_folds_that_share_batches_one_is_refused(spark, table, monkeypatch):
    path, events = table
    attempt, raced = BatchLog.attempt, []

    def late(log, label):
        if not raced and label.startswith("layer-"):
            raced.append(True)
            add(spark, path, events.limit(5), "r2", 1)
            fold_events(spark, path, TENANT)
        return attempt(log, label)

    monkeypatch.setattr(BatchLog, "attempt", late)
    try:
        assert fold_events(spark, path, TENANT) is None
    except Overlap:
        pass
    assert read_events(spark, path).count() == events.count() + 5


def test_nothing_to_fold_and_empty_batches(spark, tmp_path):
    path = str(tmp_path / "events")
    assert fold_events(spark, path, TENANT) is None
    none = usage_events(spark, SF_SMALL).limit(0)
    add(spark, path, none, "", 1), add(spark, path, none, "", 2)
    assert run_job(["fold-events", "--events-path", path, "--tenant", TENANT], spark) == 0
    assert event_batches(spark, path, TENANT) == [("", 1), ("", 2)]
    assert read_events(spark, path).isEmpty() and read_events(spark, path, event_type="app.click").isEmpty()
