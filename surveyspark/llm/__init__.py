"""Operators of a training-data pipeline: deduplication, filtering, tokenising and packing of documents."""
