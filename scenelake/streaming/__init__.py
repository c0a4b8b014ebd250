"""Structured Streaming counterparts of the ingest and labeling jobs."""
