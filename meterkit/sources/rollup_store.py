"""Rollup tables on shared storage.

Layout per meter: ``{root}/tenant={tenant}/meter={slug}/batch_id={label}/attempt={id}/window_date={d}/``.
Every write goes to a folder of its own and becomes visible by a commit in the
meter's log (``sources.batch_log``), which names the live folders and exactly
which batches each covers. Replaying a batch replaces its earlier attempt.
Readers merge states on read, so batches need not be disjoint in time.

A stream writes each epoch once, for all meters of its tenant, as one long
table: ``{root}/epochs/tenant={tenant}/batch_id={label}/attempt={id}/tenant_slug=/meter=/window_date=``,
with a log per tenant. A reader projects its meter from the epochs that the
meter's own folders do not cover, so the jobs per epoch do not grow with
meters. Epoch ``e`` of a stream is batch ``e + 1`` of its run (its checkpoint);
tenants and streams started anew may share a root.

Compaction works in layers, so its cost follows the new data, not the meter's
history: a *minor* compaction folds the batches since the last one into a layer
``c{lo}-{hi}``, a *full* one folds everything into ``f{hi}``, and a backfill
writes layers ``f{hi}`` too. These names are for people; what a layer covers is
in the log. A layer that shares some batches with another one but does not hold
them all is refused (a backfill that raced with a compaction then does the rest
again). Folders that a commit drops are deleted after a grace period, so neither
a crash nor a compaction changes what readers see, planned before or after it.
A backfill without a stream is written as ``f0``.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterkit.functions import column
from meterkit.sources.batch_log import BatchLog, Cover, Entry, Overlap, Snapshot, label_of, plain_folders
from meterkit.sources.storage import delete_path, list_subdirs, match_paths
from meterkit.operators.rollup import HLL_STATE, compact_partials, minute_partials, state_columns
from meterkit.plans.spec import MeterSpec

_FULL, _MINOR = re.compile(r"^f(\d+)$"), re.compile(r"^c(\d+)-(\d+)$")
EPOCHS = "epochs"
#: Event batches that one layer of a backfill covers at most.
PER_CHUNK = 64


def meter_root(root: str, spec: MeterSpec) -> str:
    """Two-level path, unambiguous even when tenant or slug contain ``_``."""
    return os.path.join(root, f"tenant={spec.tenant_slug}", f"meter={spec.slug}")


def rollup_schema(spec: MeterSpec) -> T.StructType:
    """Rollup columns derived from the meter spec (partition columns last)."""
    fields = [
        T.StructField("windowstart", T.TimestampType()),
        T.StructField("windowend", T.TimestampType()),
        T.StructField("organization", T.StringType()),
        T.StructField("user", T.StringType()),
    ]
    fields += [T.StructField(name, T.StringType()) for name in spec.dimensions]
    types = {"sum_v": T.DoubleType(), "cnt_v": T.LongType(), "min_v": T.DoubleType(),
             "max_v": T.DoubleType(), "uniq_v": T.StringType(), HLL_STATE: T.BinaryType()}
    fields += [T.StructField(c, types[c]) for c in state_columns(spec)]
    fields += [T.StructField("batch_id", T.StringType()), T.StructField("window_date", T.DateType())]
    return T.StructType(fields)


def _snapshot(spark: SparkSession, base: str) -> Snapshot:
    """The live folders of the table in ``base``. Folders that an earlier
    version wrote without a log are an error: their rows would be missing."""
    now = BatchLog(spark, base).snapshot()
    if now.version < 0 and plain_folders(spark, base):
        raise ValueError(f"{base} holds batches of the layout without a log; rebuild it with a backfill")
    return now


def list_batches(spark: SparkSession, root: str) -> list[str]:
    """Names of the live batches and layers under a meter root, a tenant's
    epochs, or the epochs of all tenants."""
    found = [e.label for e in BatchLog(spark, root).snapshot().entries]
    for tenant in list_subdirs(spark, root, "tenant=", False):
        found += [e.label for e in BatchLog(spark, os.path.join(root, f"tenant={tenant}")).snapshot().entries]
    return list(dict.fromkeys(found))


def _is_layer(label: str) -> bool:
    return bool(_FULL.match(label) or _MINOR.match(label))


def cover_of(label: str) -> Cover:
    """The batches that a name without a run stands for: its own, ``c{lo}-{hi}``
    those from ``lo`` to ``hi``, ``f{n}`` all up to ``n``."""
    if m := _MINOR.match(label):
        return Cover({"": [[int(m.group(1)), int(m.group(2))]]})
    if m := _FULL.match(label):
        return Cover({"": [[0, int(m.group(1))]]})
    return Cover({"": [[int(label), int(label)]]})


def write_batch(partials: DataFrame, root: str, spec: MeterSpec, batch_id: int | str, covers: Cover | None = None) -> str | None:
    """Write one batch (or layer) of partials and make it live; a batch
    or layer that covers the same is replaced. None if what it covers is, in
    part or whole, in other layers already.

    The ``rebalance`` hint hash-distributes rows by ``window_date`` and lets
    AQE size the write tasks: a busy day is split over several tasks, small
    ones are merged, so files stay few and even without a sampling job. Rows
    are sorted within each file by the rollup's sort key, so Parquet min/max
    statistics on ``windowstart`` and the dimensions skip row groups.
    """
    label = str(batch_id)
    log = BatchLog(partials.sparkSession, meter_root(root, spec))
    folder = log.attempt(label)
    keys = [column(c) for c in ("window_date", "windowstart", "organization", "user", *spec.dimensions)]
    (partials.hint("rebalance", "window_date").sortWithinPartitions(*keys)
     .write.partitionBy("window_date").parquet(os.path.join(log.base, folder)))
    try:
        added = log.add(Entry(label, folder, covers or cover_of(label)))
    except Overlap:
        return None
    return os.path.join(log.base, folder) if added else None


def epochs_root(root: str, tenant: str | None = None) -> str:
    """The folder of a tenant's epochs, or that of all tenants."""
    base = os.path.join(root, EPOCHS)
    return base if tenant is None else os.path.join(base, f"tenant={tenant}")


def write_epoch_of_all(events: DataFrame, root: str, specs: list[MeterSpec], epoch_id: int, run: str = "") -> list[str]:
    """The partials of every meter for one epoch of a run, in one write per
    tenant (replaying an epoch replaces that tenant's). Rows are clustered by
    meter and day, so few tasks hold a meter and files stay few; AQE splits a
    large meter."""
    from meterkit.operators.multi import long_partials

    paths = []
    for tenant, own in _by_tenant(specs).items():
        log, label = BatchLog(events.sparkSession, epochs_root(root, tenant)), label_of(run, epoch_id + 1)
        folder = log.attempt(label)
        long = long_partials(events, own).withColumn("window_date", F.to_date("windowstart"))
        parts = ("tenant_slug", "meter", "window_date")
        (long.hint("rebalance", *parts).sortWithinPartitions(*parts, "windowstart", "organization", "user")
         .write.partitionBy(*parts).parquet(os.path.join(log.base, folder)))
        log.add(Entry(label, folder, Cover.of([(run, epoch_id + 1)])))
        paths.append(os.path.join(log.base, folder))
    return paths


def _by_tenant(specs: list[MeterSpec]) -> dict[str, list[MeterSpec]]:
    found: dict[str, list[MeterSpec]] = {}
    for spec in specs:
        found.setdefault(spec.tenant_slug, []).append(spec)
    return found


def _epoch_schema() -> T.StructType:
    text, number = T.StringType(), T.DoubleType()
    types = {"windowstart": T.TimestampType(), "windowend": T.TimestampType(), "organization": text, "user": text,
             "dims": T.ArrayType(text), "uniq_v": text, "sum_v": number, "cnt_num": T.LongType(),
             "cnt_all": T.LongType(), "min_v": number, "max_v": number, HLL_STATE: T.BinaryType(),
             "batch_id": text, "tenant_slug": text, "meter": text, "window_date": T.DateType()}
    return T.StructType([T.StructField(n, t) for n, t in types.items()])


def _read(spark: SparkSession, root: str, spec: MeterSpec, own: list[Entry], shared: list[Entry]) -> DataFrame:
    """The meter's rows of its ``own`` folders and of the tenant's ``shared`` epochs."""
    from meterkit.operators.multi import meter_partials

    schema = rollup_schema(spec)
    columns = [column(f.name) for f in schema]
    out = spark.createDataFrame([], schema)
    if own:
        base = meter_root(root, spec)
        paths = [os.path.join(base, e.folder) for e in own]
        out = spark.read.schema(schema).option("basePath", base).parquet(*paths).select(*columns)
    if shared:
        base = epochs_root(root, spec.tenant_slug)
        paths = [os.path.join(base, e.folder) for e in shared]
        long = spark.read.schema(_epoch_schema()).option("basePath", base).parquet(*paths)
        projected = meter_partials(long, spec, keep=("batch_id", "window_date")).select(*columns)
        out = out.unionByName(projected) if own else projected
    return out


def _live(spark: SparkSession, root: str, spec: MeterSpec) -> tuple[list[Entry], list[Entry]]:
    """(the meter's own live folders, the tenant's epochs that they do not
    cover). Epochs are looked up first: one that a compaction folds and prunes
    meanwhile is then in both, and counts once; the other way round it might be
    in neither."""
    epochs_of_all = epochs_root(root)
    if list_subdirs(spark, epochs_of_all, "batch_id="):
        raise ValueError(f"{epochs_of_all} holds epochs of the layout without tenants; rebuild it with a backfill")
    epochs = _snapshot(spark, epochs_root(root, spec.tenant_slug)).entries
    own = _snapshot(spark, meter_root(root, spec))
    covered = own.covers()
    return own.entries, [e for e in epochs if not covered.holds(e.covers)]


def read_rollup(spark: SparkSession, root: str, spec: MeterSpec) -> DataFrame:
    """The meter's rollup (live batches only), ``window_date`` prunable. The
    folders are settled now: later compactions and replays do not change them."""
    return _read(spark, root, spec, *_live(spark, root, spec))


def compact(spark: SparkSession, root: str, spec: MeterSpec, full: bool = False) -> str | None:
    """Fold batches into one layer that covers exactly these.

    Minor (default): only batches that are in no layer, so the cost follows the
    data written since. Full: layers too. Epochs stay until ``prune_epochs``,
    replaced folders until ``vacuum`` finds them old enough.
    """
    own, shared = _live(spark, root, spec)
    mine = own if full else [e for e in own if not _is_layer(e.label)]
    if not mine and not shared or full and not shared and len(own) == 1 and _FULL.match(own[0].label):
        return None  # nothing to fold
    covers = Snapshot(entries=[*mine, *shared]).covers()
    numbers = [n for ranges in covers.ranges.values() for r in ranges for n in r]
    merged = compact_partials(_read(spark, root, spec, mine, shared).drop("batch_id"), spec)
    out = write_batch(merged, root, spec, f"f{max(numbers)}" if full else f"c{min(numbers)}-{max(numbers)}", covers)
    BatchLog(spark, meter_root(root, spec)).vacuum()
    return out


def compact_all(spark: SparkSession, root: str, specs: list[MeterSpec], full: bool = False, parallel: int = 8) -> list[str]:
    """M12 for all meters of a tenant (or several), as a job of its own beside the
    stream: every meter's compaction, ``parallel`` at a time, then ``prune_epochs``."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        done = list(pool.map(lambda s: compact(spark, root, s, full), specs))
    prune_epochs(spark, root, specs)
    return [d for d in done if d]


def prune_epochs(spark: SparkSession, root: str, specs: list[MeterSpec]) -> list[str]:
    """Take out the epochs that layers of every meter of their tenant in
    ``specs`` cover. Of each tenant in it the list must name all meters: an
    epoch holds all their rows. Epochs of other tenants stay."""
    gone = []
    for tenant, own in _by_tenant(specs).items():
        covers = [_snapshot(spark, meter_root(root, s)).covers() for s in own]
        log = BatchLog(spark, epochs_root(root, tenant))
        gone += [e.label for e in log.remove(lambda e, covers=covers: all(c.holds(e.covers) for c in covers))]
        log.vacuum()
    return gone


def drop_rollup(spark: SparkSession, root: str, spec: MeterSpec) -> bool:
    """Drop the meter's rollup if it exists, its part of each epoch too."""
    found = delete_path(spark, meter_root(root, spec))
    parts = os.path.join(epochs_root(root, spec.tenant_slug), "batch_id=*", "attempt=*", f"tenant_slug={spec.tenant_slug}", f"meter={spec.slug}")
    for path, _ in match_paths(spark, parts):
        found |= delete_path(spark, path)
    return found


def backfill(events: DataFrame, root: str, spec: MeterSpec) -> str | None:
    """M13 (``populate``): build the rollup from the existing events table
    as the full layer ``f0``; without ``populate`` only new events are metered."""
    if not spec.populate:
        return None
    return write_batch(minute_partials(events, spec), root, spec, "f0")


def write_many(spark: SparkSession, events: DataFrame, root: str, specs: list[MeterSpec],
               batch_id: int | str, long_path: str | None = None, parallel: int = 8,
               covers: Cover | None = None) -> list[str | None]:
    """Write one batch of every meter in ``specs`` from a single pass over
    ``events`` (see ``operators.multi``); ``covers`` as in ``write_batch``.

    The long table of all meters' partials is either written to
    ``long_path`` (large inputs: a table on shared storage, partitioned by
    meter, that the per-meter writes read back with pruning and that survives
    executor loss) or cached (small inputs). Per-meter writes then run
    ``parallel`` at a time. A stream's epochs use ``write_epoch_of_all``.
    """
    from concurrent.futures import ThreadPoolExecutor

    from meterkit.operators.multi import long_partials, meter_partials

    if not specs:
        return []
    long = long_partials(events, specs)
    if long_path is not None:
        # clustered by meter and day, so a task does not hold a file for every meter
        (long.withColumn("day", F.to_date("windowstart")).hint("rebalance", "tenant_slug", "meter", "day").drop("day")
         .write.mode("overwrite").partitionBy("tenant_slug", "meter").parquet(long_path))
        long = spark.read.parquet(long_path)
    else:
        long = long.persist()
    try:
        with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
            return list(pool.map(lambda s: write_batch(meter_partials(long, s), root, s, batch_id, covers), specs))
    finally:
        if long_path is None:
            long.unpersist()


def backfill_many(spark: SparkSession, events: DataFrame, root: str, specs: list[MeterSpec],
                  scratch: str) -> list[str | None]:
    """M13 for a whole registry: every ``populate`` meter's ``f0`` layer
    from one scan of the events table."""
    todo = [s for s in specs if s.populate]
    if not todo:
        return []
    return write_many(spark, events, root, todo, "f0", long_path=scratch)


def backfill_from_events_table(spark: SparkSession, events_path: str, root: str, specs: list[MeterSpec], scratch: str,
                               per_chunk: int = PER_CHUNK, max_chunks: int | None = None) -> str | None:
    """M13 against the ingest job's events table, race-free and resumable.

    The events table and the rollups share batch numbers (epoch ``e`` is batch
    ``e + 1`` of its run in both). Committed event batches that a meter's layers
    do not cover yet are done in chunks; each chunk is a layer that covers
    exactly its batches. So an epoch that is in the backfill and is later
    replayed by the stream is never counted twice, a meter can be added while
    ingest keeps running, and a backfill that was stopped (or told to stop after
    ``max_chunks``) goes on where it was. A chunk that a compaction overtook is
    refused, and what is then left of it is done again.

    Returns the name of the last layer.
    """
    from meterkit.sources.events import event_batches, read_events

    name, refused, chunks = None, 0, 0
    for tenant, own in _by_tenant([s for s in specs if s.populate]).items():
        while True:
            todo: dict[Cover, list[MeterSpec]] = {}
            batches = event_batches(spark, events_path, tenant)
            for spec in own:
                covered = _snapshot(spark, meter_root(root, spec)).covers()
                left = [b for b in batches if not covered.has(*b)]
                if left:
                    todo.setdefault(Cover.of(left[:per_chunk]), []).append(spec)
            if not todo:
                break
            for covers, meters in todo.items():
                if max_chunks is not None and chunks >= max_chunks:
                    return name
                wanted = [b for b in batches if covers.has(*b)]
                name = f"f{max(n for _, n in wanted)}"
                events = read_events(spark, events_path, event_type={m.event_type for m in meters}, batches=wanted, tenant=tenant)
                done = write_many(spark, events, root, meters, name, long_path=f"{scratch}-{chunks}-{refused}", covers=covers)
                chunks, refused = chunks + 1, refused + done.count(None)
                if refused > 10 * len(specs):
                    raise RuntimeError(f"compactions kept overtaking the backfill of {[s.slug for s in meters]}")
    return name


def write_epoch(partials: DataFrame, root: str, spec: MeterSpec, epoch_id: int, run: str = "") -> str | None:
    """The partials of epoch ``epoch_id`` of a run (idempotent on replay)."""
    return write_batch(partials, root, spec, label_of(run, epoch_id + 1), Cover.of([(run, epoch_id + 1)]))
