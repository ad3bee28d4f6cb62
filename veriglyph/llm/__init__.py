"""Operators for preparing training data: deduplication, search, labels, shards and tokens."""
