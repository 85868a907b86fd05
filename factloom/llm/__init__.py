"""Training-data operators: counting, scoring, extracting, deduplicating, packing and mixing text.

Nothing else in the library imports this subpackage.
"""
