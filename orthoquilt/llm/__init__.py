"""Training-data operators: tokenising, packing, near-duplicates, filters and classifiers.

Nothing outside this subpackage imports it.
"""
