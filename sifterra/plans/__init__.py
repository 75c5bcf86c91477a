"""Queries of the library's own operators over the driver's tables, with SQL oracles."""

from sifterra.plans import curation, evaluation, flows, records, texts  # noqa: F401
from sifterra.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
