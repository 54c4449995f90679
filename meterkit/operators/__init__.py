"""DataFrame operators: ingest validation, rollups, meter queries, catalog analytics."""
