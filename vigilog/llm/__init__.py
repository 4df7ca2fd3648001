"""Operators that prepare training text: deduplication, scans, quality, mixing, tokens.

Nothing outside this subpackage imports it.
"""
