"""Readers: raw text, markup, positioned items, pair TSV, records, catalogs."""
