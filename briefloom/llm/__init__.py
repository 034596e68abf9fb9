"""Operators of a training-data pipeline: deduplication, filtering, mixing, packing, scans.

Nothing outside this folder imports it (``__spark_entry__`` does so behind a guard).
"""
