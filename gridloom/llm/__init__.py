"""Training-data operators: cleaning, deduplication, scoring, packing and archiving of text at scale.

Nothing else in the library imports this subpackage.
"""
