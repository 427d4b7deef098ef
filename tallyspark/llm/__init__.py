"""Operators of a training-data pipeline: deduplication, filtering, scoring, tokenising, packing, sharding."""
