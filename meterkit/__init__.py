"""meterkit: usage rollups on Spark DataFrames.

Validated event ingest, one-minute partial-aggregate rollups merged on read,
meter queries, and batch operators over a plan catalog.
"""

from meterkit.plans.spec import MeterQuery, MeterSpec

__all__ = ["MeterQuery", "MeterSpec"]
