"""Operators for large text corpora: deduplication, quality, mixing, tokens, archives.

Nothing outside this package imports it. `queries.QUERIES` and `queries.ORACLES` register its queries.
"""
