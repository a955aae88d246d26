"""Training-data operators: deduplication, tokenisation, scoring, mixing, sharding.

Nothing outside this subpackage imports it.
"""
