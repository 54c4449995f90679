"""Readers and writers: event sources, rollup tables, catalog tables, test fixtures."""
