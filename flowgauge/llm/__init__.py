"""Operators for training-data pipelines: dedup, filters, tokens, packing and sharding.

Nothing else in the library imports this subpackage.
"""
