"""Event ingest: normalise, look up required properties, validate, split.

Rules and their order (one reason per event, first failing rule wins):

====================  ==========================================  =========
reason                rule                                        inventory
====================  ==========================================  =========
nil_event             the record is null / unparsable             V1
missing_event_type    ``type`` empty                              V2
invalid_field         ``organization`` or ``user`` empty, or      I1
                      ``id`` not a uuid when ``strict_ids``
invalid_timestamp     ``timestamp`` given but not RFC 3339        I4
missing_meter         no meter of the tenant for the type         V3
invalid_properties    properties not a JSON object, checked       V4
                      only when the type requires something
missing_properties    a required property absent or empty         V5, V6
====================  ==========================================  =========

The reference rejects a whole request for I1/I4 failures; here every event
gets its own reason (strict mode fails the batch on the first reject, V8).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterkit.functions.json import is_empty_key, json_entries
from meterkit.functions.time import second_precision
from meterkit.operators.joins import bounded_broadcast

# Rejection reasons, in rule order.
REASONS = (
    "nil_event",
    "missing_event_type",
    "invalid_field",
    "invalid_timestamp",
    "missing_meter",
    "invalid_properties",
    "missing_properties",
)

# Text patterns of a uuid and of an RFC 3339 timestamp.
UUID_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
RFC3339_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"

RAW_FIELDS = ("id", "type", "source", "organization", "user", "timestamp", "properties")


class BatchRejected(ValueError):
    """Strict mode: the batch holds at least one invalid event."""


def distinct_event_types(raw: DataFrame) -> DataFrame:
    """L1: the non-empty event types of a batch."""
    return raw.select(F.col("type").alias("event_type")).where(F.col("event_type") != "").distinct()


def meters_for_types(meters: DataFrame, event_types: DataFrame | None = None,
                     tenant: str | None = None) -> DataFrame:
    """L2: the tenant's meters whose event type occurs in ``event_types``."""
    if tenant is not None:
        meters = meters.where(F.col("tenant_slug") == F.lit(tenant))
    if event_types is not None:
        meters = meters.join(event_types, "event_type", "left_semi")
    return meters


def required_properties(meters: DataFrame, by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """L3: per event type (and tenant, with ``by``), the union of every meter's
    properties and value property, empty names dropped, sorted.

    A type whose meters require nothing keeps a row with an empty array, so
    its events pass rather than being reported as having no meter. Names are
    collected as sets, so tasks send each name of a type once.
    """
    names = F.concat(
        F.coalesce(F.col("properties"), F.array().cast("array<string>")),
        F.array(F.coalesce(F.col("value_property"), F.lit(""))),
    )
    return (meters.select(*by, F.explode(names).alias("name"))
            .groupBy(*by).agg(F.collect_set(F.when(F.col("name") != "", F.col("name"))).alias("names"))
            .select(*by, F.array_sort("names").alias("required")))


def _nil_event(raw: DataFrame) -> Column:
    present = [F.col(c).isNotNull() for c in RAW_FIELDS if c in raw.columns]
    cond = present[0]
    for p in present[1:]:
        cond = cond | p
    return ~cond


def _parsed_timestamp(text: Column) -> Column:
    """RFC 3339 text -> UTC timestamp at whole seconds; empty -> now."""
    parsed = F.when(text.rlike(RFC3339_PATTERN), F.try_to_timestamp(text))
    return F.when(F.coalesce(text, F.lit("")) == "", second_precision(F.current_timestamp())) \
        .otherwise(second_precision(parsed))


def validate(raw: DataFrame, meters: DataFrame, tenant: str | None = None,
             strict_ids: bool = False, max_broadcast_rows: int | None = None) -> DataFrame:
    """Attach ``reason`` (null when valid) and ``missing`` (names) to events.

    ``raw`` has the API fields as strings (``properties`` JSON text). The
    required-property table is one row per event type of the registry: it is
    broadcast after a row-count check and joined without shuffling the events.

    Only a tenant's own meters apply: name the ``tenant``, or carry it in a
    column ``tenant_slug`` of ``raw``. Without either, the registry must not
    have tenants.
    """
    if tenant is None and "tenant_slug" in meters.columns:
        if "tenant_slug" not in raw.columns:
            raise ValueError("the registry has tenants: name one, or give the events a tenant_slug")
        req = required_properties(meters, ("tenant_slug", "event_type")).withColumnsRenamed(
            {"event_type": "__req_type", "tenant_slug": "__req_tenant"})
        mine = raw["tenant_slug"] == F.col("__req_tenant")
    else:
        req = required_properties(meters_for_types(meters, tenant=tenant)).withColumnRenamed("event_type", "__req_type")
        mine = F.lit(True)
    req = bounded_broadcast(req, max_broadcast_rows) if max_broadcast_rows else bounded_broadcast(req)
    df = raw.join(req, (raw["type"] == req["__req_type"]) & mine, "left")

    props = F.col("properties")
    if "properties" in raw.columns and dict(raw.dtypes)["properties"] != "string":
        props = F.to_json(props)
    # Parse once into its own column: lambdas (the per-key emptiness test)
    # are outside subexpression elimination, so referencing the parse
    # expression inside them would re-parse the JSON for every key.
    df = df.select("*", json_entries(props).alias("__parsed"),
                   _parsed_timestamp(F.col("timestamp")).alias("__timestamp"))
    df = df.withColumn("__missing", F.filter("required", lambda k: is_empty_key(F.col("__parsed"), k)))
    id_ok = F.lit(True) if not strict_ids else \
        (F.coalesce(F.col("id"), F.lit("")) == "") | F.col("id").rlike(UUID_PATTERN)
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""

    reason = (
        F.when(_nil_event(raw), F.lit("nil_event"))
        .when(empty("type"), F.lit("missing_event_type"))
        .when(empty("organization") | empty("user") | ~id_ok, F.lit("invalid_field"))
        .when(F.col("__timestamp").isNull(), F.lit("invalid_timestamp"))
        .when(F.col("required").isNull(), F.lit("missing_meter"))
        .when((F.size("required") > 0) & F.col("__parsed").isNull(), F.lit("invalid_properties"))
        .when(F.size("__missing") > 0, F.lit("missing_properties"))
    )
    # The stored id, decided once here so every output of the batch (events
    # table, topic) carries the same one. The stream's batches come with ids
    # already (``streaming.ingest.with_stable_ids``); others get random ones.
    stored_id = F.when(F.coalesce(F.col("id"), F.lit("")) == "", F.expr("uuid()")).otherwise(F.col("id"))
    return df.select(
        *[F.col(c) for c in raw.columns],
        "__timestamp",
        stored_id.alias("__id"),
        reason.alias("reason"),
        F.when(reason == "missing_properties", F.col("__missing")).alias("missing"),
    )


def typed_events(validated: DataFrame) -> DataFrame:
    """Accepted events in stored form (I2, I3, I5 applied)."""
    props = F.col("properties")
    if dict(validated.dtypes)["properties"] != "string":
        props = F.to_json(props)
    return validated.where(F.col("reason").isNull()).select(
        F.col("__id").alias("id"),
        "type",
        F.coalesce(F.col("source"), F.lit("")).alias("source"),
        "organization",
        "user",
        F.col("__timestamp").alias("timestamp"),
        F.coalesce(props, F.lit("null")).alias("properties"),
    )


def rejected_events(validated: DataFrame) -> DataFrame:
    """Rejected events with their reason and the missing names."""
    keep = [c for c in validated.columns if c not in ("__timestamp", "__id")]
    return validated.where(F.col("reason").isNotNull()).select(*keep)


def split(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """V8 (partial success): accepted events and rejected events."""
    return typed_events(validated), rejected_events(validated)


def reason_counts(validated: DataFrame) -> DataFrame:
    """V9: events per outcome (``reason`` null = accepted)."""
    return validated.groupBy("reason").agg(F.count(F.lit(1)).alias("events"))


def ensure_all_valid(validated: DataFrame) -> None:
    """V8 (strict): raise if any event of the batch is rejected."""
    bad = validated.where(F.col("reason").isNotNull()).select("reason").limit(1).collect()
    if bad:
        raise BatchRejected(f"batch rejected: {bad[0]['reason']}")


class BatchError(ValueError):
    """A publish call the reference answers with an error."""


def publish(raw: DataFrame, meters: DataFrame, tenant: str | None = None,
            allow_partial_success: bool = True, strict_ids: bool = False) -> tuple[DataFrame, DataFrame]:
    """V8 as one batch call: validate, then decide like the reference's
    publish endpoint.

    * an empty batch, or one without any non-empty event type, is an error (L1);
    * strict mode (``allow_partial_success=False``) fails on the first reject;
    * partial mode fails only when no event is accepted.

    Returns ``(accepted, rejected)``, persisted so that both and the decision
    see one evaluation (default ids and times are decided once); unpersist them
    when done. The decision comes from one row of counts.
    """
    validated = validate(raw, meters, tenant=tenant, strict_ids=strict_ids).persist()
    events, typed, accepted = validated.agg(
        F.count(F.lit(1)), F.count(F.when(F.col("type") != "", 1)), F.count(F.when(F.col("reason").isNull(), 1))).first()
    error = None
    if not events:
        error = BatchError("the batch holds no events")
    elif not typed:
        error = BatchError("no event of the batch names a type")
    elif allow_partial_success and not accepted:
        error = BatchError("every event of the batch was rejected")
    if error:
        validated.unpersist()
        raise error
    if not allow_partial_success:
        ensure_all_valid(validated)
    return split(validated)
