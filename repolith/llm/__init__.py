"""Operators of a training-data pipeline: deduplication, filters, mixing, packing and scoring.

Nothing outside this subpackage imports it.
"""
