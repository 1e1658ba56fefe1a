"""Queries that bind the operators to the driver's tables, each with its SQL."""

from . import aggregates, joins, streams, tables
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "aggregates", "joins", "streams", "tables"]
