"""Operators for training-data pipelines: filters, deduplication, mixing, tokenizing.

Nothing outside this subpackage imports it.
"""
