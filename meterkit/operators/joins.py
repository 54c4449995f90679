"""Join helpers: broadcast only behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest side, in rows, that is broadcast without a shuffle.
DEFAULT_BROADCAST_ROWS = 200_000


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only if it has at most ``max_rows`` rows.

    The check runs ``limit(max_rows + 1).count()``, which stops reading once
    the bound is passed. Beyond the bound the plain DataFrame is returned and
    Spark plans a shuffle join (AQE may still switch to a broadcast at run
    time from measured sizes).
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df
