"""Training-data operators: extraction, scoring, filtering, deduplication, sharding and packing.

Nothing else in the library imports this subpackage.
"""
