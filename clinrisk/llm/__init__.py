"""Operators for large text corpora: quality, duplicates, contamination, secrets, languages, packing."""
