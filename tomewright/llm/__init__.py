"""Training-corpus operators: deduplication, packing, mixing, filtering and scoring.

Nothing else in the library imports this subpackage.
"""
