"""Training-data operators: deduplication, filtering, extraction, archives and packing.

Nothing outside this package imports it, so it can be removed on its own.
"""
