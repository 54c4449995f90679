"""Batch and streaming jobs for ``spark-submit`` (the reference's endpoints as jobs).

    spark-submit meterkit/jobs.py backfill --events PATH --rollup-root ROOT --meter meter.json --tenant acme
    spark-submit meterkit/jobs.py ingest   --tenant acme --meters meters.json
                                            --source DIR | --kafka HOST:PORT --topic T --starting-offsets earliest|latest ...
    spark-submit meterkit/jobs.py compact  --rollup-root ROOT --tenant acme [--full] --meter meter.json | --meters meters.json
    spark-submit meterkit/jobs.py query    --rollup-root ROOT --meter meter.json --tenant acme --query q.json --out OUT
    spark-submit meterkit/jobs.py drop     --rollup-root ROOT --meter meter.json --tenant acme
    spark-submit meterkit/jobs.py changes  --changes changes.json --plans PLANS --state S --history H
                                            --outcomes O --batch-id N

``meter.json`` is a ``POST /v1/meters`` body, ``q.json`` a ``POST /v1/meters/query``
body, ``meters.json`` a JSON-lines file of registry rows (event_type,
value_property, properties, aggregation, slug, tenant_slug). Results are
written, never collected: ``OUT/rows`` (flat columns) and ``OUT/range`` (the
response envelope's window range).
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import uuid

if __package__ in (None, ""):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from meterkit.operators.query import query_rollup, result_range  # noqa: E402
from meterkit.plans.requests import meter_query_from_request, meter_spec_from_request  # noqa: E402
from meterkit.session import build_session  # noqa: E402
from meterkit.sources import rollup_store as store  # noqa: E402


# Change requests (POST / PUT / DELETE on assignments), one JSON object per line.
CHANGE_SCHEMA = ("change_id string, seq long, action string, plan_id string, organization_id string, "
                 "user_id string, valid_from timestamp, valid_until timestamp, clear_valid_until boolean, "
                 "requested_at timestamp")


def _load(path: str) -> dict:
    """One JSON body, from wherever Spark can read."""
    return json.loads(_session().read.text(path, wholetext=True).first()[0])


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or build_session()


def _registry(spark: SparkSession, path: str):
    return spark.read.schema("slug string, event_type string, aggregation string, value_property string, "
                             "properties array<string>, tenant_slug string").json(path)


def _spec(args):
    return meter_spec_from_request(_load(args.meter), args.tenant)


def run(argv: list[str], spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="meterkit.jobs")
    sub = parser.add_subparsers(dest="command", required=True)

    def meter_args(p):
        p.add_argument("--rollup-root", required=True)
        p.add_argument("--meter", required=True)
        p.add_argument("--tenant", required=True)

    p = sub.add_parser("backfill")
    meter_args(p)
    p.add_argument("--events", required=True)
    p = sub.add_parser("compact")
    p.add_argument("--rollup-root", required=True)
    p.add_argument("--tenant", required=True)
    which = p.add_mutually_exclusive_group(required=True)
    which.add_argument("--meter")
    which.add_argument("--meters", help="the whole registry; covered epochs of the tenant are deleted")
    p.add_argument("--full", action="store_true")
    p = sub.add_parser("fold-events")
    p.add_argument("--events-path", required=True)
    p.add_argument("--tenant", required=True)
    p.add_argument("--full", action="store_true", help="fold earlier layers too")
    p = sub.add_parser("query")
    meter_args(p)
    p.add_argument("--query", required=True)
    p.add_argument("--out", required=True)
    p = sub.add_parser("drop")
    meter_args(p)
    p = sub.add_parser("changes")
    p.add_argument("--changes", required=True)
    p.add_argument("--plans", required=True)
    p.add_argument("--state", required=True)
    p.add_argument("--history", required=True)
    p.add_argument("--outcomes", required=True)
    p.add_argument("--batch-id", type=int, required=True)
    p = sub.add_parser("ingest")
    p.add_argument("--source")
    p.add_argument("--kafka")
    p.add_argument("--topic")
    p.add_argument("--meters", required=True)
    p.add_argument("--tenant", required=True)
    p.add_argument("--starting-offsets", choices=("earliest", "latest"), help="needed with --kafka")
    p.add_argument("--publish-to", nargs=2, metavar=("HOST:PORT", "TOPIC"), help="also send accepted events there")
    p.add_argument("--strict-ids", action="store_true")
    p.add_argument("--events-path", required=True)
    p.add_argument("--rejects-path", required=True)
    p.add_argument("--rollup-root", required=True)
    p.add_argument("--checkpoint", required=True)
    p.add_argument("--available-now", action="store_true")
    args = parser.parse_args(argv)
    if args.command == "ingest":
        if bool(args.source) == bool(args.kafka):
            parser.error("give either --source or --kafka")
        if args.kafka and not (args.topic and args.starting_offsets):
            parser.error("--kafka needs --topic and --starting-offsets")

    spark = spark or build_session()
    if args.command == "backfill":
        from meterkit.session import scratch_path
        spec = _spec(args)
        store.backfill_from_events_table(spark, args.events, args.rollup_root, [spec],
                                         scratch_path(spark, f"backfill-{uuid.uuid4().hex}"))
    elif args.command == "compact":
        if args.meters:
            from meterkit.streaming.ingest import meter_specs
            store.compact_all(spark, args.rollup_root, meter_specs(_registry(spark, args.meters), args.tenant), args.full)
        else:
            store.compact(spark, args.rollup_root, _spec(args), full=args.full)
    elif args.command == "fold-events":
        from meterkit.sources.batch_log import BatchLog
        from meterkit.sources.events import fold_events, tenant_root
        fold_events(spark, args.events_path, args.tenant, full=args.full)
        BatchLog(spark, tenant_root(args.events_path, args.tenant)).vacuum()
    elif args.command == "drop":
        store.drop_rollup(spark, args.rollup_root, _spec(args))
    elif args.command == "query":
        spec = _spec(args)
        slug, q = meter_query_from_request(_load(args.query))
        if slug != spec.slug:
            raise ValueError(f"query names meter {slug!r}, spec is {spec.slug!r}")
        result = query_rollup(store.read_rollup(spark, args.rollup_root, spec), spec, q)
        result.write.mode("overwrite").parquet(os.path.join(args.out, "rows"))
        written = spark.read.parquet(os.path.join(args.out, "rows"))
        result_range(written, q).write.mode("overwrite").parquet(os.path.join(args.out, "range"))
    elif args.command == "changes":
        from meterkit.sources.assignments_store import apply_change_batch
        changes = spark.read.schema(CHANGE_SCHEMA).json(args.changes)
        apply_change_batch(spark, changes, spark.read.parquet(args.plans), args.state, args.history,
                           args.outcomes, args.batch_id)
    elif args.command == "ingest":
        from meterkit.streaming.ingest import file_event_source, kafka_event_source, start_ingest
        source = kafka_event_source(spark, args.kafka, args.topic, args.starting_offsets) if args.kafka \
            else file_event_source(spark, args.source)
        query = start_ingest(source, lambda: _registry(spark, args.meters), None, args.events_path, args.rejects_path,
                             args.rollup_root, args.checkpoint, tenant=args.tenant, available_now=args.available_now,
                             kafka_sink=tuple(args.publish_to) if args.publish_to else None, strict_ids=args.strict_ids)
        query.awaitTermination()
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
