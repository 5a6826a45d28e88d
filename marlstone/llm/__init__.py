"""Training-data operators: formatting, filtering, extraction, deduplication, packing.

Nothing outside this subpackage imports it.
"""
