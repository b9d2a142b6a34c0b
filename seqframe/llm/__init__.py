"""Operators for training-data pipelines: archives, scoring, filtering, deduplication, packing, search."""
