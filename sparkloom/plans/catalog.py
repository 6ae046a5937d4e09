"""All registered queries of the library proper, by key, with the SQL that states the same."""

from . import aggregates, filters, generators, joins, retrieval, routing, scalars, sets, sinks, windows, streams  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
