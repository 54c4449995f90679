"""Exact unique counts as mergeable bitmaps.

The exact form of ``operators.rollup`` keeps a row with the whole text of every
distinct value of a minute group. Here a stored dictionary gives each value a
number, and a group's state is the set of its numbers, cut into buckets of
32,768 (``bitmap_bucket_number``). A bucket's set is kept the cheaper way:

* ``positions``: up to ``SPARSE`` numbers of the bucket as short integers;
* ``bitmap``: beyond that, 4,096 bytes of ``bitmap_construct_agg``.

So a record is bounded, sets of other batches are united by position or by
``bitmap_or_agg``, and a read counts bits instead of comparing texts. A group
with any number of values is spread over its buckets. Nothing is approximate.

The dictionary is append-only, so states stay valid when it grows. Numbers are
dense per task that numbered them and start on a bucket's border.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterkit.functions import column
from meterkit.operators.query import _dimension_filters, _time_range, _window_keys
from meterkit.operators.rollup import VALUE, extract, group_columns
from meterkit.plans.spec import MeterQuery, MeterSpec, MeterSpecError
from meterkit.sources.batch_log import BatchLog, Cover, Entry
from meterkit.sources.storage import delete_path

#: Fixed value: numbers per bucket of Spark's bitmap functions.
BUCKET = 32_768
#: A bucket with more numbers than this is kept as a bitmap: 1,024 short
#: integers are half a bitmap's bytes.
SPARSE = 1024

DICTIONARY = "uniq_v string, number bigint"
STATE = ("bucket", "positions", "bitmap")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(uniq_v, number) of the newest version; empty if there is none."""
    folders = [os.path.join(path, e.folder) for e in BatchLog(spark, path).snapshot().entries]
    return spark.read.schema(DICTIONARY).parquet(*folders) if folders else spark.createDataFrame([], DICTIONARY)


def add_values(values: DataFrame, path: str) -> DataFrame:
    """Numbers the values (column ``uniq_v``, repeats allowed) that the stored
    dictionary lacks, and returns the dictionary with them.

    The new part becomes visible as one version of the dictionary's log, and
    only if no other writer came between; else the values are looked up again,
    so a value never has two numbers, nor a number two values. A writer that
    dies before that leaves the dictionary as it was.
    """
    spark = values.sparkSession
    log = BatchLog(spark, path)
    while True:
        now = log.snapshot()
        known = read_dictionary(spark, path)
        last = known.agg(F.max("number")).first()[0]
        base = 0 if last is None else (last // BUCKET + 1) * BUCKET
        new = values.select("uniq_v").where("uniq_v is not null").distinct().join(known, "uniq_v", "left_anti")
        number = now.version + 1
        folder = log.attempt(str(number))
        # written at once: the numbers hold from then on
        new.select("uniq_v", (F.monotonically_increasing_id() + F.lit(base)).alias("number")).write.parquet(os.path.join(path, folder))
        entry = Entry(str(number), folder, Cover.of([("", number)]))
        if log.commit(lambda s: [*s.entries, entry] if s.version == now.version else None):  # noqa: B023
            return read_dictionary(spark, path)
        delete_path(spark, os.path.join(path, folder))


def _require_unique(spec: MeterSpec) -> None:
    if spec.aggregation != "unique_count":
        raise MeterSpecError(f"bitmaps are states of unique_count meters, not of {spec.aggregation!r}")


def _states(rows: DataFrame, keys: list[str], span: bool = False) -> DataFrame:
    """(keys, bucket, positions, bitmap) of rows (keys, bucket, position,
    bitmap): all sets of a bucket united, in the cheaper form; with ``span``
    also the earliest start and latest end of the rows.

    A bucket has at most 32,768 positions, so the collected set is bounded; it
    is combined map-side, and so are bitmaps, in an exchange of their own: the
    groups without one (most, where users have few values) carry none.
    """
    named = [*(column(k) for k in keys), F.col("bucket")]
    ends = [F.min("windowstart").alias("windowstart"), F.max("windowend").alias("windowend")] if span else []
    kept = ["windowstart", "windowend"] if span else []
    bitmaps = rows.where("bitmap is not null").groupBy(*named).agg(F.bitmap_or_agg("bitmap").alias("bitmap"), *ends)
    every = rows.where("bitmap is null").unionByName(bitmaps.withColumn("position", F.lit(None).cast("smallint")))
    sets = every.groupBy(*named).agg(F.collect_set("position").alias("positions"), F.max("bitmap").alias("bitmap"), *ends)
    few = F.col("bitmap").isNull() & (F.size("positions") <= SPARSE)
    sparse = sets.where(few).withColumn("positions", F.sort_array("positions"))
    # the groupings below find their rows where they are
    many = sets.where(~few).withColumn("position", F.explode_outer("positions"))
    both = many.groupBy(*named).agg(F.bitmap_construct_agg("position").alias("positions"), F.max("bitmap").alias("bitmap"), *ends)
    dense = (both.withColumn("bitmap", F.explode(F.array("positions", "bitmap")))
             .groupBy(*named).agg(F.bitmap_or_agg("bitmap").alias("bitmap"), *ends))
    dense = dense.withColumn("positions", F.lit(None).cast("array<smallint>"))
    names = [*named, "positions", "bitmap", *kept]
    return sparse.select(*names).unionByName(dense.select(*names))


def _key_names(spec: MeterSpec) -> list[str]:
    return ["windowstart", "windowend", "organization", "user", *spec.dimensions, "window_date"]


def bitmap_partials(events: DataFrame, spec: MeterSpec, dictionary: DataFrame) -> DataFrame:
    """Minute states of the events of one meter: its grain, ``window_date`` and
    STATE. Every value must be in ``dictionary`` (``add_values``); one that is
    not fails the query rather than being left out.
    """
    spec.validate(require_properties=False)
    _require_unique(spec)
    keys = _key_names(spec)
    # a value once per group before it meets the dictionary
    rows = extract(events, spec).select(*group_columns(spec), F.col(VALUE).alias("uniq_v")).distinct()
    rows = rows.withColumn("window_date", F.to_date("windowstart")).join(dictionary, "uniq_v", "left")
    number = F.coalesce("number", F.raise_error(F.concat(F.lit("value without a number: "), "uniq_v")).cast("bigint"))
    return _states(rows.select(
        *(column(k) for k in keys), F.bitmap_bucket_number(number).alias("bucket"),
        F.bitmap_bit_position(number).cast("smallint").alias("position"), F.lit(None).cast("binary").alias("bitmap")), keys)


def _opened(states: DataFrame, keys: list[str]) -> DataFrame:
    """A row per position, and one per bitmap."""
    return states.select(*(column(k) for k in keys), "bucket", F.explode_outer("positions").alias("position"), "bitmap")


def merge_bitmaps(states: DataFrame, spec: MeterSpec) -> DataFrame:
    """States of several batches folded to one row per grain and bucket."""
    _require_unique(spec)
    keys = _key_names(spec)
    return _states(_opened(states, keys), keys)


def query_bitmaps(states: DataFrame, spec: MeterSpec, q: MeterQuery) -> DataFrame:
    """Q9: a meter query from bitmap states; the rows of ``query_rollup``.

    States of different batches need not have been merged. Sets are united per
    result group and bucket, map-side first, then counted.
    """
    _require_unique(spec)
    q.validate(spec)
    df = _time_range(_dimension_filters(states, q), q, "window_date" in states.columns)
    whole = q.window_size is None
    opened = _opened(df, ["windowstart", "windowend", *q.group_by])
    if not whole:
        start, end = _window_keys(q)
        opened = opened.withColumns({"windowstart": start, "windowend": end})
    keys = [*q.group_by] if whole else ["windowstart", "windowend", *q.group_by]
    ends = [F.min("windowstart").alias("windowstart"), F.max("windowend").alias("windowend")] if whole else []
    count = F.when(F.col("bitmap").isNull(), F.size("positions")).otherwise(F.bitmap_count("bitmap"))
    value = F.coalesce(F.sum(count), F.lit(0)).cast("double").alias("value")
    out = _states(opened, keys, span=whole).groupBy(*(column(k) for k in keys)).agg(value, *ends)
    return out.select("windowstart", "windowend", "value", *(column(d) for d in q.group_by))
