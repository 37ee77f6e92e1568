"""Incremental ingest (an extension)."""
