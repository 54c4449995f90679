"""Training-data operators: scoring, deduplication, sharding, tokens, quality."""
