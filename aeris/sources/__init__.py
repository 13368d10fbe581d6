"""Scans, fixture mappings, sinks and incremental ingest."""
