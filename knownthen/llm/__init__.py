"""Operators of a training-data pipeline: deduplication, filtering, token counts and packing."""
