"""Requests over the catalog and the plans they turn into."""
