"""Operators for preparing text corpora: archives, duplicates, quality, contamination, tokens."""
