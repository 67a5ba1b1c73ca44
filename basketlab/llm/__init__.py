"""Operators for large text corpora: scanning, near duplicates, scoring and packing."""
