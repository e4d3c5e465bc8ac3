"""Training-data operators: deduplication, filtering, scoring, mixing and sharding of large text corpora.

Nothing else in the library imports this subpackage.
"""
