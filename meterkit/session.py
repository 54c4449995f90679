"""Spark session defaults of all jobs.

Everything here is plain session configuration: UTC wall clock (the reference
only accepts UTC windows), adaptive execution for runtime re-planning and
skew splitting, and a checkpoint directory taken from the cluster when set.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # per-tenant pages use a partial group limit before the shuffle when
    # offset + limit stays under this bound (default 1000): 100 pages of 100
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
    # Python workers get whole texts in batches of bounded size
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}

# Of these, the ones set when an application starts.
AT_START = ("spark.ui.enabled", "spark.ui.showConsoleProgress")


def build_session(master: str | None = None, app_name: str = "meterkit",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session with the defaults applied."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    apply_defaults(spark)
    return spark


def apply_defaults(spark: SparkSession) -> None:
    """Pin the SQL settings the operators depend on on an existing session."""
    for key, value in SESSION_DEFAULTS.items():
        if key not in AT_START:
            spark.conf.set(key, value)


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is used
    as is. Only a local-mode session (tests, local runs) may fall back to a
    scratch folder of its own; a cluster session without the setting is an
    error, so lineage cuts never land on a machine-local path.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder on shared storage")
        configured = tempfile.mkdtemp(prefix="meterkit-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediates."""
    return os.path.join(checkpoint_dir(spark), name)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing ``df`` as Parquet under the shared checkpoint
    folder and reading it back. Later jobs that reuse the result (several
    outputs of one fold, for instance) neither recompute it nor depend on the
    executors that computed it."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
