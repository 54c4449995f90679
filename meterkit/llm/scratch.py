"""Written intermediates in the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterkit.session import scratch_path

#: Ids that are broadcast at most, and bytes of them (as text).
SMALL_IDS, SMALL_ID_BYTES = 2_000_000, 64 << 20


def write_scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under ``spark.checkpoint.dir`` and read it back.

    The folder name carries a fresh id, so concurrent runs never overwrite
    each other, and later jobs neither recompute ``df`` nor depend on the
    executors that computed it.
    """
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, or the first of ``wanted_1``, ... that no column has."""
    lower, name, n = {c.lower() for c in taken}, wanted, 0
    while name.lower() in lower:
        n += 1
        name = f"{wanted}_{n}"
    return name


def numbered(df: DataFrame, *columns: str) -> tuple[DataFrame, *tuple[str, ...]]:
    """``df`` with its columns named by number, and the new names of
    ``columns``: Spark's Arrow maps take no names with dots."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), *(names[df.columns.index(c)] for c in columns)


def without_ids(df: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """The rows of ``df`` whose id (null like any other) is not among the
    distinct ids of ``gone`` (one column; a written table, read twice).

    While they are few, by count and bytes, they are broadcast and the rows
    stay where they lie, texts and all; more of them are joined by a shuffle.
    """
    name = free_name(df.columns, "__gone_id")
    gone = gone.toDF(name)
    n, size = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(name).cast("string"))), F.lit(0))).first()
    if not n:
        return df
    few = n <= SMALL_IDS and size <= SMALL_ID_BYTES
    gone = F.broadcast(gone) if few else gone.hint("shuffle_hash")
    return df.join(gone, F.col(id_col).eqNullSafe(F.col(name)), "left_anti")
