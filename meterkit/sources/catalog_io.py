"""Catalog tables (S9): meters, plans, features, plan-features, quotas,
assignments and history, read from a table, a path or a JDBC source.

Catalog tables are small next to events; operators broadcast them behind a
row-count bound (``operators.joins.bounded_broadcast``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The catalog tables of the reference's schema.
CATALOG_TABLES = ("meter", "plan", "feature", "plan_feature", "plan_feature_quota", "plan_assignment",
                  "plan_assignment_history")


def read_catalog(spark: SparkSession, name: str, location: str | None = None, fmt: str = "parquet") -> DataFrame:
    """A catalog table by metastore name, or from ``location`` in ``fmt``."""
    if name not in CATALOG_TABLES:
        raise ValueError(f"unknown catalog table {name!r}")
    if location is None:
        return spark.table(name)
    return spark.read.format(fmt).load(location)


def read_catalog_jdbc(spark: SparkSession, name: str, url: str, properties: dict[str, str],
                      partition_column: str | None = None, lower_bound: int | None = None,
                      upper_bound: int | None = None, num_partitions: int | None = None) -> DataFrame:
    """A catalog table straight from the relational store over JDBC.

    With a numeric ``partition_column`` and bounds the read is split into
    ``num_partitions`` parallel range queries.
    """
    if name not in CATALOG_TABLES:
        raise ValueError(f"unknown catalog table {name!r}")
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    for key, value in properties.items():
        reader = reader.option(key, value)
    if partition_column is not None:
        reader = (reader.option("partitionColumn", partition_column)
                  .option("lowerBound", str(lower_bound)).option("upperBound", str(upper_bound))
                  .option("numPartitions", str(num_partitions or 8)))
    return reader.load()
