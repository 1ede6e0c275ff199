"""Training-data operators: deduplication, media, tokens, scoring, packing.

Nothing else in the library imports this subpackage.
"""
