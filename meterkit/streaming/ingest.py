"""Continuous ingest: event log -> validate -> events, rejects, rollups.

One Structured Streaming query reads the event log (Kafka in production, a
JSON-lines file stream in tests), and ``foreachBatch`` runs the batch
operators on every micro-batch:

1. validate against the meter registry (broadcast after a size check),
2. append accepted events to the events table (S2) and rejects (S8),
3. reduce accepted events to minute partials of all meters and write them as
   that epoch's batch, in one job whatever the number of meters (M14).

The meter registry is read anew for each micro-batch, so a meter registered
while the stream runs is maintained from the next one on. Compaction is a job
of its own (``rollup_store.compact_all``).

Every write goes to a folder of its own and replaces the epoch's earlier
attempt when it commits (``sources.batch_log``), so a micro-batch replayed
after a failure (same epoch id, same offsets) does not add: results are
exactly-once although the sinks are plain Parquet. Epochs are those of a run:
the checkpoint's query id is part of every batch, so a stream started with a
new checkpoint, or another tenant's, adds to the tables and replaces nothing.
Events without an id get one from the run, the epoch and their place or
content, the same again when the epoch is replayed. State lives in the rollup
tables, not in the state store, so there is no watermark and no late event is
dropped (F14): a late event lands in its minute and is merged on read.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from meterkit.functions.json import is_json_object
from meterkit.operators import ingest
from meterkit.plans.spec import MeterSpec
from meterkit.sources.batch_log import BatchLog, Cover, Entry, label_of
from meterkit.sources.events import tenant_root
from meterkit.sources.rollup_store import write_epoch_of_all
from meterkit.sources.storage import create_if_absent, list_files, read_text

# Queue form, every field a string (properties as JSON text).
RAW_EVENT_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in ingest.RAW_FIELDS])


#: A column of a raw event that says where in its source it stands.
PLACE = "place"


def parse_event_lines(lines: DataFrame, column: str = "value", place: Column | None = None) -> DataFrame:
    """JSON line -> the seven raw fields (and ``place``, where it is known).

    A line that is not a JSON object gives all nulls (``nil_event``); in a
    line that is one, absent fields are ``''`` as Go's decoder leaves them
    (so ``{}`` is an event with an empty type). ``properties`` given as an
    object is kept as its JSON text.
    """
    text = F.col(column).cast("string")
    placed = [] if place is None else [place.alias(PLACE)]
    decoded = lines.select(F.from_json(text, RAW_EVENT_SCHEMA).alias("__e"), is_json_object(text).alias("__ok"), *placed)
    return decoded.select(*[F.when(F.col("__ok"), F.coalesce(F.col(f"__e.{n}"), F.lit(""))).alias(n)
                            for n in ingest.RAW_FIELDS], *([PLACE] if placed else []))


def with_stable_ids(raw: DataFrame, seed: str) -> DataFrame:
    """Events without an id get one that a replay of the same batch gives
    them again: a uuid-shaped md5 of ``seed`` and the event's place in its
    source. Where the source has no places it is the event's content, and equal
    events are numbered: they are counted (map-side first) and spread again, so
    a replay gives the same set of ids however its rows are dealt.
    """
    fields = [c for c in ingest.RAW_FIELDS if c != "id" and c in raw.columns]
    bare = (F.coalesce(F.col("id"), F.lit("")) == "") & F.coalesce(
        *[F.when(F.col(c).isNotNull(), True) for c in ("id", *fields)], F.lit(False))

    def named(*parts: Column) -> Column:
        h = F.md5(F.concat_ws("|", F.lit(seed), *parts).cast("binary"))
        cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
        return F.concat_ws("-", *(F.substring(h, at, n) for at, n in cuts))

    if PLACE in raw.columns:
        return raw.withColumn("id", F.when(bare, named(F.col(PLACE))).otherwise(F.col("id"))).drop(PLACE)
    content = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c in fields]
    columns = raw.columns
    counted = (raw.where(bare).groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
               .withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("__n")))))
    spread = counted.withColumn("id", named(*content, F.col("__nth").cast("string"))).select(*columns)
    return raw.where(~bare).unionByName(spread)


#: Fixed value: the queue's own timestamp form, UTC seconds without a zone.
QUEUE_TIMESTAMP = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}$"


def from_queue(raw: DataFrame) -> DataFrame:
    """Raw events as the topic carries them, in the API's form: producers strip
    the zone before publishing, so a zone-less timestamp is UTC. (API forms pass
    unchanged.)"""
    ts = F.col("timestamp")
    return raw.withColumn("timestamp", F.when(ts.rlike(QUEUE_TIMESTAMP), F.concat(F.translate(ts, " ", "T"), F.lit("Z"))).otherwise(ts))


def kafka_event_source(spark: SparkSession, bootstrap_servers: str, topic: str, starting_offsets: str) -> DataFrame:
    """The event topic (needs the spark-sql-kafka package on the classpath).

    ``starting_offsets`` has no default: "earliest" meters everything still in
    the topic at the first start, "latest" skips it. Later starts go on from
    the checkpoint."""
    lines = (spark.readStream.format("kafka")
             .option("kafka.bootstrap.servers", bootstrap_servers)
             .option("subscribe", topic)
             .option("startingOffsets", starting_offsets)
             .load())
    return from_queue(parse_event_lines(lines, place=F.concat_ws("/", "topic", "partition", "offset")))


def file_event_source(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """S1 stand-in: a directory of JSON-lines files, read as a stream."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return from_queue(parse_event_lines(reader.load(path)))


def kafka_records(valid: DataFrame) -> DataFrame:
    """Accepted events as Kafka records keyed ``{organization}-{user}``
    (the key spreads partitions by org-user as the reference's producer does),
    with the timestamp in the queue's form."""
    ts = "timestamp"
    columns = [F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias(ts) if c == ts and dict(valid.dtypes)[ts] == "timestamp" else F.col(c)
               for c in valid.columns]
    return valid.select(
        F.concat_ws("-", "organization", "user").alias("key"),
        F.to_json(F.struct(*columns)).alias("value"),
        F.array(F.struct(F.lit("content-type").alias("key"),
                         F.lit("application/json").cast("binary").alias("value"))).alias("headers"),
    )


def publish_to_kafka(valid: DataFrame, bootstrap_servers: str, topic: str) -> None:
    """Write accepted events to the event topic (needs the spark-sql-kafka
    package). Records are keyed ``{organization}-{user}``, so the broker's key
    partitioner keeps one organization-user pair on one partition. Kafka sinks
    are at-least-once: an epoch that failed before it was marked as published
    sends its records again, with the same ids, by which consumers can drop them."""
    (kafka_records(valid).write.format("kafka")
     .option("kafka.bootstrap.servers", bootstrap_servers).option("topic", topic).save())


#: Meters of one tenant that a registry may hold (they are brought to the driver
#: to plan the aggregation, about 200 bytes each).
MAX_METERS = 100_000


def meter_specs(meters: DataFrame, tenant: str) -> list[MeterSpec]:
    """The tenant's registry rows as specs; a registry beyond MAX_METERS is an error."""
    names = ("slug", "event_type", "aggregation", "value_property", "properties")
    if not set(names) <= set(meters.columns):
        raise ValueError(f"a meter registry needs the columns {', '.join(names)}")
    rows = meters.where(F.col("tenant_slug") == tenant).select(*names).limit(MAX_METERS + 1).collect()
    if len(rows) > MAX_METERS:
        raise ValueError(f"more than {MAX_METERS} meters for tenant {tenant!r}")
    return [MeterSpec(r.slug, r.event_type, r.aggregation, r.value_property, tuple(r.properties or ()), tenant_slug=tenant) for r in rows]


def run_of(spark: SparkSession, checkpoint_location: str) -> str:
    """The run of a checkpoint: part of its query's id, which Spark keeps there."""
    query = json.loads(read_text(spark, os.path.join(checkpoint_location, "metadata")))["id"]
    return f"r{query.replace('-', '')[:12]}"


def _append(df: DataFrame, path: str, tenant: str, run: str, number: int, by: str | None = None) -> None:
    """Write one batch of a tenant's table and make it live. Written from the
    input partitions (no shuffle of the raw stream); the writer sorts each
    task's rows by the partition column locally."""
    log, label = BatchLog(df.sparkSession, tenant_root(path, tenant)), label_of(run, number)
    folder, writer = log.attempt(label), df.write
    (writer.partitionBy(by) if by else writer).parquet(os.path.join(log.base, folder))
    log.add(Entry(label, folder, Cover.of([(run, number)])))


def read_rejects(spark: SparkSession, path: str, tenant: str) -> DataFrame:
    """The rejected events of a tenant's committed batches."""
    base = tenant_root(path, tenant)
    folders = [os.path.join(base, e.folder) for e in BatchLog(spark, base).snapshot().entries]
    if not folders:
        raise ValueError(f"no batch of rejects under {base}")
    return spark.read.option("basePath", base).parquet(*folders).drop("attempt")


def process_batch(batch: DataFrame, epoch_id: int, meters: DataFrame, specs: Sequence[MeterSpec] | None,
                  events_path: str, rejects_path: str, rollup_root: str, tenant: str,
                  kafka_sink: tuple[str, str] | None = None, strict_ids: bool = False, run: str = "") -> dict[str, int]:
    """The body of one micro-batch (also usable as a plain batch job).

    The validated batch is cached once; all meters' partials come from one
    aggregation over it and are written in one job. ``specs`` left out are read
    from the registry. ``run`` tells streams apart that write the same tables.
    Returns the batch's counts (V9), observed while the batch is first computed
    (no extra job).
    """
    if not tenant:
        raise ValueError("ingest needs the tenant whose meters apply")
    if specs is None:
        specs = meter_specs(meters, tenant)
    counts = Observation(f"ingest_{epoch_id}")
    named = with_stable_ids(batch, f"{run}/{epoch_id}")
    validated = ingest.validate(named, meters, tenant=tenant, strict_ids=strict_ids).observe(
        counts, F.count(F.lit(1)).alias("events"),
        F.count(F.when(F.col("reason").isNull(), F.lit(1))).alias("accepted")).persist()
    try:
        valid = (ingest.typed_events(validated)
                 .withColumn("ingested_at", F.current_timestamp())
                 .withColumn("event_date", F.to_date("timestamp")))
        _append(valid, events_path, tenant, run, epoch_id + 1, by="event_date")
        _append(ingest.rejected_events(validated).withColumn("missing", F.array_join("missing", ",")),
                rejects_path, tenant, run, epoch_id + 1)
        stored = valid.drop("ingested_at", "event_date")
        if kafka_sink is not None:
            publish_once(stored, kafka_sink, os.path.join(tenant_root(events_path, tenant), "_published"), label_of(run, epoch_id + 1))
        if specs:
            write_epoch_of_all(stored, rollup_root, list(specs), epoch_id, run)
        seen = counts.get
        return {"events": seen["events"], "accepted": seen["accepted"],
                "rejected": seen["events"] - seen["accepted"]}
    finally:
        validated.unpersist()


def publish_once(valid: DataFrame, sink: tuple[str, str], marks: str, label: str, send: Callable = publish_to_kafka) -> bool:
    """Sends an epoch's events and marks it as published; a marked epoch is not sent again."""
    if label in list_files(valid.sparkSession, marks):
        return False
    send(valid, *sink)
    return create_if_absent(valid.sparkSession, f"{marks}/{label}", "")


def start_ingest(source: DataFrame, meters: DataFrame | Callable[[], DataFrame], specs: Sequence[MeterSpec] | None,
                 events_path: str, rejects_path: str, rollup_root: str, checkpoint_location: str, tenant: str,
                 available_now: bool = False, processing_time: str | None = None,
                 kafka_sink: tuple[str, str] | None = None, strict_ids: bool = False) -> StreamingQuery:
    """Start the continuous ingest query of a tenant.

    ``meters`` is the registry, or a function that reads it, called for each
    micro-batch. ``specs`` left out follow the registry; given, they are fixed.
    """
    if not tenant:
        raise ValueError("ingest needs the tenant whose meters apply")

    def run(batch: DataFrame, epoch_id: int) -> None:
        registry = meters() if callable(meters) else meters
        process_batch(batch, epoch_id, registry, specs, events_path, rejects_path, rollup_root, tenant, kafka_sink=kafka_sink,
                      strict_ids=strict_ids, run=run_of(batch.sparkSession, checkpoint_location))

    writer = source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint_location)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
