"""Operators for building training corpora: filtering, extraction, deduplication, labelling, packing.

Nothing else in the library imports this subpackage. ``registry`` lists its queries and SQL.
"""
