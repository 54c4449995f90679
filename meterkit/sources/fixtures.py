"""Views over the driver's test tables shaped like the reference's inputs.

Each function reads the whole parquet tables under ``sf_dir`` and derives the
usage or catalog table with DataFrame expressions, so the work grows with
the data. The same derivations, written in DuckDB SQL, are the oracle's
inputs (``meterkit.checks.oracle``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterkit.functions.time import second_precision


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k(props="props"):
    return F.get_json_object(F.col(props), "$.k")


def _slug(col: str) -> F.Column:
    return F.lower(F.replace(F.col(col), F.lit(" "), F.lit("_")))


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: typed usage events (id, type, source, organization, user,
    timestamp, properties) with properties ``{"k": "kN", "page": "pM",
    "amount": <value>}``."""
    ev = table(spark, sf_dir, "events")
    k = _k()
    properties = F.concat(
        F.lit('{"k":"k'), k,
        F.lit('","page":"p'), (k.cast("int") % 10).cast("string"),
        F.lit('","amount":'), F.col("value").cast("string"),
        F.lit("}"))
    return ev.select(
        F.concat(F.lit("evt_"), F.col("event_id").cast("string")).alias("id"),
        F.concat(F.lit("app."), F.col("event_type")).alias("type"),
        F.when(F.col("event_id") % 2 == 0, F.lit("web_api")).otherwise(F.lit("mobile_api")).alias("source"),
        F.concat(F.lit("org_"), (F.col("user_id") % 10).cast("string")).alias("organization"),
        F.concat(F.lit("usr_"), F.col("user_id").cast("string")).alias("user"),
        second_precision(F.col("ts").cast("timestamp")).alias("timestamp"),
        properties.alias("properties"),
    )


# One defect per residue of event_id % 50 (FIXTURES B7).
DIRTY_TYPE_EMPTY = 7
DIRTY_TYPE_UNKNOWN = 11
DIRTY_PROPS_BROKEN = 13
DIRTY_PROPS_ARRAY = 15
DIRTY_NO_AMOUNT = 17
DIRTY_AMOUNT_EMPTY = 19
DIRTY_K_NULL = 23
DIRTY_PAGE_EMPTY_ARRAY = 29
DIRTY_PROPS_EMPTY_TEXT = 31
DIRTY_PROPS_EMPTY_OBJECT = 33
DIRTY_PROPS_NULL_TEXT = 37
DIRTY_PAGE_EMPTY_OBJECT = 39
DIRTY_AMOUNT_NOT_NUMBER = 41
DIRTY_TIMESTAMP = 43
DIRTY_PRESENT_EDGE = 45
DIRTY_ORGANIZATION_EMPTY = 47


def dirty_raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API-form events (all strings) with one defect per event_id % 50.

    ``timestamp`` is RFC 3339 text; ``properties`` is JSON text or ``null``.
    Row ``event_id`` is kept as ``seq`` for checking.
    """
    ev = table(spark, sf_dir, "events")
    r = F.col("event_id") % 50
    k = _k()
    amount = F.col("value").cast("string")
    page = F.concat(F.lit("p"), (k.cast("int") % 10).cast("string"))

    def obj(amount_json, k_json, page_json):
        parts = []
        if k_json is not None:
            parts.append(F.concat(F.lit('"k":'), k_json))
        if page_json is not None:
            parts.append(F.concat(F.lit('"page":'), page_json))
        if amount_json is not None:
            parts.append(F.concat(F.lit('"amount":'), amount_json))
        return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))

    k_str = F.concat(F.lit('"k'), k, F.lit('"'))
    page_str = F.concat(F.lit('"'), page, F.lit('"'))
    good = obj(amount, k_str, page_str)
    properties = (
        F.when(r == DIRTY_PROPS_BROKEN, F.lit("{bad"))
        .when(r == DIRTY_PROPS_ARRAY, F.lit("[1]"))
        .when(r == DIRTY_NO_AMOUNT, obj(None, k_str, page_str))
        .when(r == DIRTY_AMOUNT_EMPTY, obj(F.lit('""'), k_str, page_str))
        .when(r == DIRTY_K_NULL, obj(amount, F.lit("null"), page_str))
        .when(r == DIRTY_PAGE_EMPTY_ARRAY, obj(amount, k_str, F.lit("[]")))
        .when(r == DIRTY_PROPS_EMPTY_TEXT, F.lit(""))
        .when(r == DIRTY_PROPS_EMPTY_OBJECT, F.lit("{}"))
        .when(r == DIRTY_PROPS_NULL_TEXT, F.lit("null"))
        .when(r == DIRTY_PAGE_EMPTY_OBJECT, obj(amount, k_str, F.lit("{}")))
        .when(r == DIRTY_AMOUNT_NOT_NUMBER, obj(F.lit('"abc"'), k_str, page_str))
        .when(r == DIRTY_PRESENT_EDGE,
              F.when(F.col("event_id") % 100 < 50, obj(F.lit("0"), k_str, page_str))
              .otherwise(obj(amount, k_str, F.lit('"[]"'))))
        .otherwise(good)
    )
    event_type = (F.when(r == DIRTY_TYPE_EMPTY, F.lit(""))
                  .when(r == DIRTY_TYPE_UNKNOWN, F.lit("unknown.type"))
                  .otherwise(F.concat(F.lit("app."), F.col("event_type"))))
    timestamp = (F.when(r == DIRTY_TIMESTAMP, F.lit("not-a-time"))
                 .otherwise(F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")))
    organization = (F.when(r == DIRTY_ORGANIZATION_EMPTY, F.lit(""))
                    .otherwise(F.concat(F.lit("org_"), (F.col("user_id") % 10).cast("string"))))
    return ev.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("evt_"), F.col("event_id").cast("string")).alias("id"),
        event_type.alias("type"),
        F.when(F.col("event_id") % 2 == 0, F.lit("web_api")).otherwise(F.lit("mobile_api")).alias("source"),
        organization.alias("organization"),
        F.concat(F.lit("usr_"), F.col("user_id").cast("string")).alias("user"),
        timestamp.alias("timestamp"),
        properties.alias("properties"),
    )


def dirty_meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B7 registry: every ``app.*`` event type gets two meters, ``sum`` of
    ``amount`` by ``page`` and ``unique_count`` of ``k`` by ``page``.

    The event types come from the events table itself (one row per type).
    """
    types = table(spark, sf_dir, "events").select(
        F.concat(F.lit("app."), F.col("event_type")).alias("event_type")).distinct()
    two = F.explode(F.array(
        F.struct(F.lit("sum").alias("aggregation"), F.lit("amount").alias("value_property")),
        F.struct(F.lit("unique_count").alias("aggregation"), F.lit("k").alias("value_property")),
    ))
    return (types.select("event_type", two.alias("m"))
            .select(
                F.concat(F.col("event_type"), F.lit("."), F.col("m.aggregation")).alias("slug"),
                "event_type",
                F.col("m.aggregation").alias("aggregation"),
                F.col("m.value_property").alias("value_property"),
                F.array(F.lit("page")).alias("properties"),
                F.lit("acme").alias("tenant_slug"),
            ))
