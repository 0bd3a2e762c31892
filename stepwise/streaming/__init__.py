"""Structured Streaming jobs: slice ingest, schema-drift monitor, error monitor."""
