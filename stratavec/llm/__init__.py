"""Operators for preparing text corpora: filters, deduplication, tokens, packing.

Nothing else in the library imports this package.
"""
