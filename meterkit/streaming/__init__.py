"""Structured Streaming jobs: continuous ingest and rollup maintenance."""
