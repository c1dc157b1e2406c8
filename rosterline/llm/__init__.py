"""Operators of a training-data pipeline: cleaning, deduplication, mixing, packing, sharding and archives."""
