"""Training-data operators: deduplication, filters, scoring, tokenising, sharding.

Nothing outside this package imports it, so it can be removed as a whole.
"""
