"""Operators for building training corpora: scoring, deduplication, cleaning and mixing at scale."""
