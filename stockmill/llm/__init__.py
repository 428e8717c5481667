"""Operators for training-data pipelines: text filters, near-duplicates, sharding, pieces."""
