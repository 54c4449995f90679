"""Events table (S2, S3): typed events on shared storage.

Written by the ingest job as ``{path}/tenant={t}/batch_id={label}/attempt={id}/event_date={d}/``,
with a log per tenant that names the live folders (``sources.batch_log``); read
back with partition pruning on ``event_date`` and a pushed-down ``timestamp``
range, so a backfill or a direct meter query over a time window lists and reads
only the days it needs. ``fold_events`` turns the many small batches of a
stream into layers of few files per date, clustered by type, with an index of
the types and times in each file: a read opens only the files that hold its
type. Rows keep the label of their batch. Plain folders ``{path}/batch_id={n}/event_date={d}/``
without a log are read by their ``_SUCCESS`` markers.
"""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterkit.sources.batch_log import BatchLog, Cover, Entry, label_of, plain_folders
from meterkit.sources.storage import list_subdirs

EVENTS_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("organization", T.StringType()),
    T.StructField("user", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("properties", T.StringType()),
    T.StructField("ingested_at", T.TimestampType()),
    T.StructField("batch_id", T.StringType()),
    T.StructField("event_date", T.DateType()),
])


def tenant_root(path: str, tenant: str) -> str:
    return os.path.join(path, f"tenant={tenant}")


#: Of a layer's rows: the label of the batch they came with.
BATCH_LABEL = "batch_label"
#: Index of a layer (Spark's listings skip names with an underscore).
INDEX = "_files"
INDEX_SCHEMA = "file string, type string, first timestamp, last timestamp, events bigint"
#: File names of an index that are brought to the driver at most; a read that
#: needs more files lists the layer's folders instead.
MAX_FILES = 100_000


def _batches(covers: Cover) -> list[tuple[str, int]]:
    return [(run, n) for run, ranges in covers.ranges.items() for lo, hi in ranges for n in range(lo, hi + 1)]


def _is_layer(entry: Entry) -> bool:
    return entry.label.startswith("layer-")


def _folders(spark: SparkSession, path: str, tenant: str | None) -> list[tuple[str, list[Entry]]]:
    """Per table base (a tenant's, or ``path`` itself if it has no tenants) its
    live folders and their batches."""
    tenants = list_subdirs(spark, path, "tenant=", committed_only=False)
    bases = [tenant_root(path, t) for t in sorted(tenants) if tenant in (None, t)] if tenants else [path]
    out = []
    for base in bases:
        now = BatchLog(spark, base).snapshot()
        live = now.entries
        if now.version < 0:
            numbers = [(f, f.split("=")[1]) for f in plain_folders(spark, base)]
            live = [Entry(n, f, Cover.of([("", int(n))])) for f, n in numbers if n.isdigit()]
        out.append((base, live))
    return out


def event_batches(spark: SparkSession, path: str, tenant: str | None = None) -> list[tuple[str, int]]:
    """(run, number) of the committed batches of a tenant's events (of all)."""
    return sorted({b for _, live in _folders(spark, path, tenant) for e in live for b in _batches(e.covers)})


def _layer_files(spark: SparkSession, folder: str, start: dt.datetime | None, end: dt.datetime | None,
                 types: list[str] | None) -> list[str]:
    """The paths of a layer that a read of ``types`` in ``[start, end)`` has to open."""
    if start is None and end is None and types is None:
        return [folder]
    files = spark.read.schema(INDEX_SCHEMA).parquet(os.path.join(folder, INDEX))
    if types is not None:
        files = files.where(F.col("type").isin(types))
    if start is not None:
        files = files.where(F.col("last") >= F.lit(start))
    if end is not None:
        files = files.where(F.col("first") < F.lit(end))
    names = [r.file for r in files.select("file").distinct().limit(MAX_FILES + 1).collect()]
    return [folder] if len(names) > MAX_FILES else [os.path.join(folder, name) for name in sorted(names)]


def read_events(spark: SparkSession, path: str, start: dt.datetime | None = None,
                end: dt.datetime | None = None, event_type: str | Iterable[str] | None = None,
                batches: list[int | tuple[str, int]] | None = None, tenant: str | None = None) -> DataFrame:
    """S3: typed events, optionally limited to ``[start, end)``, one type (or
    some), one tenant and some batches (a number alone is one without a run). Of
    the ingest job's table, committed batches only; a folder without batches is
    read as it is."""
    wanted = None if batches is None else {b if isinstance(b, tuple) else ("", b) for b in batches}
    types = None if event_type is None else [event_type] if isinstance(event_type, str) else sorted(set(event_type))
    columns = [f.name for f in EVENTS_SCHEMA]
    parts: list[DataFrame] = []

    def read(base: str, paths: list[str], schema: T.StructType = EVENTS_SCHEMA) -> DataFrame:
        return spark.read.schema(schema).option("basePath", base).parquet(*paths)

    if list_subdirs(spark, path, "tenant=", committed_only=False) or list_subdirs(spark, path, "batch_id=", committed_only=False):
        for base, live in _folders(spark, path, tenant):
            single: list[str] = []
            for e in live:
                own = _batches(e.covers)
                some = own if wanted is None else [b for b in own if b in wanted]
                folder = os.path.join(base, e.folder)
                if not some:
                    continue
                if not _is_layer(e):
                    single.append(folder)
                    continue
                paths = _layer_files(spark, folder, start, end, types)
                if paths:
                    layer = read(base, paths, T.StructType([*EVENTS_SCHEMA.fields, T.StructField(BATCH_LABEL, T.StringType())]))
                    layer = layer.withColumn("batch_id", F.col(BATCH_LABEL))
                    if len(some) < len(own):
                        layer = layer.where(F.col(BATCH_LABEL).isin([label_of(*b) for b in some]))
                    parts.append(layer.select(*columns))
            if single:
                parts.append(read(base, single).select(*columns))
        if not parts:
            return spark.createDataFrame([], EVENTS_SCHEMA)
    else:
        parts.append(spark.read.schema(EVENTS_SCHEMA).parquet(path))
    df = parts[0]
    for part in parts[1:]:
        df = df.unionByName(part)
    if start is not None:
        df = df.where((F.col("event_date") >= F.lit(start.date())) & (F.col("timestamp") >= F.lit(start)))
    if end is not None:
        last = (end - dt.timedelta(microseconds=1)).date()
        df = df.where((F.col("event_date") <= F.lit(last)) & (F.col("timestamp") < F.lit(end)))
    if types is not None:
        df = df.where(F.col("type") == F.lit(types[0]) if len(types) == 1 else F.col("type").isin(types))
    return df


def _index_of(spark: SparkSession, folder: str) -> DataFrame:
    """The types, times and row counts of a written layer's files. Rows are grouped
    by their file's path as it is; its last two names are cut out of the groups."""
    written = spark.read.schema(T.StructType([f for f in EVENTS_SCHEMA if f.name in ("type", "timestamp", "event_date")])).parquet(folder)
    return (written.groupBy(F.col("_metadata.file_path").alias("file"), "type")
            .agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.count(F.lit(1)).alias("events"))
            .withColumn("file", F.substring_index("file", "/", -2)))


def fold_events(spark: SparkSession, path: str, tenant: str, min_batches: int = 2, full: bool = False) -> str | None:
    """Folds a tenant's batches that are in no layer yet into a new layer (with
    ``full``, its layers too). Returns the layer's label, or None where fewer
    than ``min_batches`` folders are there to fold.

    One range exchange on (date, type, time): a date's files follow each other by
    type, and a busy date and type has several. The layer takes the place of
    what it folds in one commit, so no reader sees a row twice or not at all;
    queries planned before keep the old folders until ``vacuum``. A batch
    replayed in the meantime (another attempt of the same rows) is either
    folded or found to be in the layer. Of two folds at once that share some
    batches one is refused (``Overlap``). Rows keep every column and their batch.
    """
    base = tenant_root(path, tenant)
    log = BatchLog(spark, base)
    now = log.snapshot()
    old = [e for e in now.entries if full or not _is_layer(e)]
    if len(old) < max(min_batches, 1):
        return None
    covers = Cover()
    for e in old:
        covers = covers | e.covers
    # ``batch_id`` of a single batch's folder is its label
    rows = read_events(spark, path, batches=_batches(covers), tenant=tenant).withColumnRenamed("batch_id", BATCH_LABEL)
    label = f"layer-{now.version + 1}"
    live = log.attempt(label)
    folder = os.path.join(base, live)
    by = ["event_date", "type", "timestamp", "id"]
    (rows.repartitionByRange(*by).sortWithinPartitions(*by)
     .write.partitionBy("event_date").parquet(folder))
    _index_of(spark, folder).write.parquet(os.path.join(folder, INDEX))
    return label if log.add(Entry(label, live, covers)) else None
