"""Operators for large training corpora: scans, filters, near-duplicates, mixing, sharding, packing."""
