"""Assignment state and change history on shared storage (C17-C19 persisted).

Layout: the state is cut into BUCKETS by a hash of the assignment key.
``{state}/version={n}/bucket={b}/`` holds bucket ``b`` after change batch ``n``
(version 0 is the initial load), for the buckets that batch touched only;
``{state}/touched={n}/`` lists them and is written last. ``{history}/batch_id={n}/``
holds the history rows batch ``n`` produced; ``{outcomes}/batch_id={n}/`` its
per-change outcomes. A bucket's state is its newest version. Applying batch
``n`` reads versions below ``n``, so replaying a batch recomputes the same
result and overwrites its own outputs: idempotent without a transactional table
format. ``prune_versions`` deletes what newer versions replace.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterkit.operators import changes as chg
from meterkit.sources.storage import delete_path, list_subdirs

#: Buckets of the state. A bucket is rewritten whole when a change names one of
#: its keys, so tables of very many assignments want more of them.
BUCKETS = 64
FIELDS = ("id", "plan_id", "organization_id", "user_id", "valid_from", "valid_until", "created_at")
SCHEMA = ("id string, plan_id string, organization_id string, user_id string, valid_from timestamp, "
          "valid_until timestamp, created_at timestamp, bucket int")


def _bucket() -> Column:
    return F.pmod(F.xxhash64(*(F.coalesce(c, F.lit("")) for c in chg.KEY)), F.lit(BUCKETS)).cast("int")


def _versions(spark: SparkSession, state_path: str) -> list[int]:
    return sorted(int(v) for v in list_subdirs(spark, state_path, "touched=") if v.isdigit())


def _write(state: DataFrame, touched: DataFrame, state_path: str, version: int) -> None:
    """One version: the rows of the touched buckets, then the list of them."""
    (state.select(*FIELDS).withColumn("bucket", _bucket()).hint("rebalance", "bucket")
     .write.mode("overwrite").partitionBy("bucket").parquet(os.path.join(state_path, f"version={version}")))
    touched.coalesce(1).write.mode("overwrite").parquet(os.path.join(state_path, f"touched={version}"))


def write_initial_state(assignments: DataFrame, state_path: str) -> None:
    spark = assignments.sparkSession
    _write(assignments, spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")), state_path, 0)


def _newest(spark: SparkSession, state_path: str, before: int | None) -> dict[int, int]:
    """For each bucket the newest committed version (below ``before`` if given)."""
    versions = [v for v in _versions(spark, state_path) if before is None or v < before]
    if not versions:
        raise ValueError(f"no committed assignment state under {state_path}")
    lists = [os.path.join(state_path, f"touched={v}") for v in versions]
    every = spark.read.option("basePath", state_path).parquet(*lists).withColumnRenamed("touched", "version")
    return {r.bucket: r.version for r in every.groupBy("bucket").agg(F.max("version").alias("version")).collect()}


def read_state(spark: SparkSession, state_path: str, before: int | None = None, buckets: set[int] | None = None) -> DataFrame:
    """The newest committed assignment state (below ``before`` if given), of
    all buckets or some."""
    paths = []
    for version in sorted(set((newest := _newest(spark, state_path, before)).values())):
        there = list_subdirs(spark, os.path.join(state_path, f"version={version}"), "bucket=", committed_only=False)
        # a touched bucket without rows has no folder
        paths += [os.path.join(state_path, f"version={version}", f"bucket={b}") for b in there
                  if newest.get(int(b)) == version and (buckets is None or int(b) in buckets)]
    if not paths:
        return spark.createDataFrame([], SCHEMA).select(*FIELDS)
    return spark.read.schema(SCHEMA).option("basePath", state_path).parquet(*paths).select(*FIELDS)


def prune_versions(spark: SparkSession, state_path: str, keep_from: int) -> list[int]:
    """Delete bucket folders of versions below ``keep_from`` that a later
    version up to it replaces. Batches below ``keep_from`` can't be replayed
    afterwards. Returns the versions that lost folders."""
    newest, lost = _newest(spark, state_path, keep_from + 1), []
    for version in [v for v in _versions(spark, state_path) if v < keep_from]:
        root = os.path.join(state_path, f"version={version}")
        gone = [b for b in list_subdirs(spark, root, "bucket=", committed_only=False) if newest.get(int(b)) != version]
        for b in gone:
            delete_path(spark, os.path.join(root, f"bucket={b}"))
        lost += [version] * bool(gone)
    return lost


def apply_change_batch(spark: SparkSession, changes: DataFrame, plans: DataFrame, state_path: str,
                       history_path: str, outcomes_path: str, batch_id: int) -> dict[str, str]:
    """Fold change batch ``batch_id`` (>= 1) into the stored state and persist
    the history rows, the outcomes and the touched buckets' new state. Other
    buckets are neither read nor written."""
    if batch_id < 1:
        raise ValueError("change batches are numbered from 1 (version 0 is the initial state)")
    ids = {r.bucket for r in changes.select(_bucket().alias("bucket")).distinct().collect()}  # BUCKETS rows at most
    current = read_state(spark, state_path, before=batch_id, buckets=ids)
    folded = chg.apply_changes_materialized(current, changes, plans, name=f"assignment_fold_{uuid.uuid4().hex}")
    out = {
        "history": os.path.join(history_path, f"batch_id={batch_id}"),
        "outcomes": os.path.join(outcomes_path, f"batch_id={batch_id}"),
        "state": os.path.join(state_path, f"version={batch_id}"),
    }
    chg.history_rows(folded).write.mode("overwrite").parquet(out["history"])
    chg.change_outcomes(folded).write.mode("overwrite").parquet(out["outcomes"])
    touched = spark.createDataFrame([(b,) for b in sorted(ids)], "bucket int")
    _write(chg.final_assignments(folded), touched, state_path, batch_id)
    return out


def read_history(spark: SparkSession, history_path: str) -> DataFrame:
    """C16's input: every committed history batch."""
    batches = [b for b in list_subdirs(spark, history_path, "batch_id=") if b.isdigit()]
    if not batches:
        raise ValueError(f"no committed history under {history_path}")
    return spark.read.option("basePath", history_path).parquet(
        *[os.path.join(history_path, f"batch_id={b}") for b in batches])
