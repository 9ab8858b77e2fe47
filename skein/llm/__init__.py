"""Operators for building training corpora: tokenising, filtering, deduplicating, scoring and mixing text."""
