"""Catalogue search and ingest expressed as Spark DataFrame jobs."""
