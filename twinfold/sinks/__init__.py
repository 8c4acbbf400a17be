"""Writers: pair TSV, records, chapters."""
