"""Operators of a training-data pipeline: tokenising, deduplication, scanning, packing, formatting, archives."""
