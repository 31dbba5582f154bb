"""Readers, writers and ingest reshaping."""
