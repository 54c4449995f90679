"""Many meters from one pass over the events (M1-M11 for a meter registry).

Building each meter's rollup on its own scans the events once per meter;
with a registry of hundreds of meters over a large events table that is
hundreds of full scans. Here the events are read once:

1. the meters' definitions are cut down to *sub-aggregates*: meters of the same
   event type and dimensions share one, whatever their tenant, aggregation
   and (up to ``SLOTS`` of them) numeric value property. An exact unique count
   or a sketch shares one with the meters that also count the same property;
2. events join the sub-aggregates on ``type = event_type`` (broadcast; their number
   is known on the driver), with the properties text parsed once *before* the
   join. An event fans out to the sub-aggregates of its type, not to its meters;
3. every row carries the dimension values as an array in sorted property order,
   and the numeric value of each slot or the text value;
4. one aggregation keyed by (sub-aggregate, minute window, organization, user,
   dimension values, distinct value for exact unique meters) produces every
   state at once: sum, numeric count, min, max per slot, and the row count;
5. the aggregated rows, no longer events, are handed to the meters of their
   sub-aggregate, each with the states of its slot; ``meter_partials`` projects one
   meter's rows into its rollup schema.

HLL meters keep a sketch in the same aggregation; the column is only built
when the registry has such a meter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterkit.functions.json import number, text_map
from meterkit.functions.time import window_end, window_start
from meterkit.operators.joins import DEFAULT_BROADCAST_ROWS
from meterkit.operators.rollup import HLL_LG_CONFIG_K, HLL_STATE, measured
from meterkit.plans.spec import MeterSpec

LONG_KEYS = ["tenant_slug", "meter", "windowstart", "windowend", "organization", "user", "dims", "uniq_v"]


#: Numeric value properties that one sub-aggregate holds states of.
SLOTS = 4


def sub_aggregates(specs: Sequence[MeterSpec]) -> tuple[list[tuple], list[tuple]]:
    """What to aggregate for ``specs``: rows (part, event type, dimensions, value
    properties, exact unique, sketched), and the meters they serve: rows (part,
    tenant, meter, slot), slot null for meters that read no number."""
    parts: dict[tuple, list[str]] = {}  # (type, dimensions, kind, n-th of its kind or property) -> value properties
    places = []
    for s in specs:
        s.validate(require_properties=False)
        base = (s.event_type, s.dimensions)
        if s.aggregation == "unique_count":
            key, slot = (*base, s.unique_mode, s.value_property), None
            parts[key] = [s.value_property]
        elif not s.value_property:
            key, slot = (*base, "number", 0), None
            parts.setdefault(key, [])
        else:
            n = 0
            while s.value_property not in (held := parts.setdefault((*base, "number", n), [])) and len(held) == SLOTS:
                n += 1
            if s.value_property not in held:
                held.append(s.value_property)
            key, slot = (*base, "number", n), held.index(s.value_property)
        places.append((key, s.tenant_slug, s.slug, slot))
    number_of = {key: i for i, key in enumerate(parts)}
    rows = [(number_of[key], key[0], list(key[1]), values, key[2] == "exact", key[2] == "hll")
            for key, values in parts.items()]
    return rows, [(number_of[key], *rest) for key, *rest in places]


def _small(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """Meter metadata as a DataFrame, broadcast while it is within the bound."""
    df = spark.createDataFrame(rows, ddl)
    return F.broadcast(df) if len(rows) <= DEFAULT_BROADCAST_ROWS else df


def fan_out(events: DataFrame, parts: list[tuple]) -> DataFrame:
    """One row per event and sub-aggregate of its type (M1-M4)."""
    defs = _small(events.sparkSession, parts, "part int, event_type string, dim_names array<string>, "
                                              "value_names array<string>, exact_unique boolean, sketched boolean")
    parsed = (events.where(F.col("type").isin(*sorted({p[1] for p in parts})))
              .select("type", "organization", "user", "timestamp",
                      text_map(F.col("properties")).alias("__props")))
    joined = parsed.join(defs, parsed["type"] == defs["event_type"])
    props = F.col("__props")

    def text(slot: int) -> Column:
        name = F.get("value_names", F.lit(slot))
        return F.when(name.isNotNull(), F.coalesce(F.try_element_at(props, name), F.lit("")))

    start = window_start(F.col("timestamp"), "minute")
    numeric = ~F.col("exact_unique") & ~F.col("sketched")
    return joined.select(
        "part", start.alias("windowstart"), window_end(start, "minute").alias("windowend"), "organization", "user",
        F.transform("dim_names", lambda k: F.coalesce(F.try_element_at(props, k), F.lit(""))).alias("dims"),
        F.when(F.col("exact_unique"), text(0)).alias("uniq_v"),
        F.when(F.col("sketched"), text(0)).alias("__sketch"),
        *(F.when(numeric, number(text(i))).alias(f"__num{i}") for i in range(_slots(parts))))


def _slots(parts: list[tuple]) -> int:
    return max([1, *(len(p[3]) for p in parts)])


def long_partials(events: DataFrame, specs: Sequence[MeterSpec]) -> DataFrame:
    """Minute partials of all ``specs`` in one long table (one shuffle).

    Columns: ``LONG_KEYS`` + ``sum_v, cnt_num, cnt_all, min_v, max_v, uniq_hll``.
    ``uniq_v`` is the distinct value for exact unique meters, null otherwise;
    ``uniq_hll`` the sketch of HLL meters, null otherwise.
    """
    parts, meters = sub_aggregates(specs)
    slots = range(_slots(parts))
    states = [F.count(F.lit(1)).alias("cnt_all")]
    for i in slots:
        num = F.col(f"__num{i}")
        states += [F.sum(num).alias(f"__sum{i}"), F.count(num).alias(f"__cnt{i}"), F.min(num).alias(f"__min{i}"),
                   F.max(num).alias(f"__max{i}")]
    sketch = F.lit(None).cast("binary")
    if any(p[5] for p in parts):
        states.append(F.when(F.count("__sketch") > 0, F.hll_sketch_agg("__sketch", HLL_LG_CONFIG_K)).alias("__hll"))
        sketch = F.col("__hll")
    merged = fan_out(events, parts).groupBy("part", *LONG_KEYS[2:]).agg(*states)
    owners = _small(events.sparkSession, meters, "part int, tenant_slug string, meter string, slot int")

    def of_slot(name: str) -> Column:
        return F.get(F.array(*(F.col(f"__{name}{i}") for i in slots)), F.col("slot"))

    return merged.join(owners, "part").select(
        *LONG_KEYS, of_slot("sum").alias("sum_v"), F.coalesce(of_slot("cnt"), F.lit(0)).cast("long").alias("cnt_num"), "cnt_all",
        of_slot("min").alias("min_v"), of_slot("max").alias("max_v"), sketch.alias(HLL_STATE))


def meter_partials(long: DataFrame, spec: MeterSpec, keep: tuple[str, ...] = ()) -> DataFrame:
    """One meter's rollup rows, in the same schema as ``minute_partials``; with
    ``keep``, these columns of ``long`` instead of a derived ``window_date``."""
    df = long.where((F.col("tenant_slug") == spec.tenant_slug) & (F.col("meter") == spec.slug))
    dims = [F.col("dims")[i].alias(name) for i, name in enumerate(spec.dimensions)]
    keys = [F.col(c) for c in ("windowstart", "windowend", "organization", "user")] + dims
    agg = spec.aggregation
    if agg == "unique_count":
        states = [F.col(HLL_STATE if spec.unique_mode == "hll" else "uniq_v")]
    elif agg == "count":
        states = [F.col("cnt_num" if spec.value_property else "cnt_all").alias("cnt_v")]
    elif agg == "avg":
        states = [F.col("sum_v"), F.col("cnt_num").alias("cnt_v")]
    else:
        states = [F.col({"sum": "sum_v", "min": "min_v", "max": "max_v"}[agg])]
    out = measured(df.select(*keys, *states, *keep), spec)
    return out if keep else out.withColumn("window_date", F.to_date("windowstart"))
