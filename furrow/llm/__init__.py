"""Operators for training-data pipelines: text quality, mixing, sharding, deduplication, archives."""
