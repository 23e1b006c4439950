"""Operators for preparing training text: deduplication, filtering, tokenisation, mixing.

Nothing else in the library imports this subpackage.
"""
