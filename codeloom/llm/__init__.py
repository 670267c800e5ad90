"""Operators for preparing training text: filters, deduplication, search, packing and mixing.

Nothing outside this subpackage imports it.
"""
