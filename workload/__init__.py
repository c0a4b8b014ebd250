"""Registered queries: the library's operators over the given tables, each with its SQL twin."""

from workload.registry import ORACLES, QUERIES
from workload import clouds, extensions, geometry, joins, labels, requests, scalars, stores, streams, writes  # noqa: F401,E402

__all__ = ["ORACLES", "QUERIES"]
