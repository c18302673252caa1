"""Operators for training-data pipelines: scoring, duplicates, extraction, mixing, packing, sharding."""
