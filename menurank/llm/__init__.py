"""Operators for preparing training data: deduplication, scoring, selection, mixing.

Nothing outside this subpackage imports it.
"""
