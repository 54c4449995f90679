"""Meter definitions, meter queries and their validation."""
