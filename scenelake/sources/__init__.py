"""Readers, writers and ingest of raw recordings."""
