"""Bilingual corpus alignment and its queries as Spark jobs."""
