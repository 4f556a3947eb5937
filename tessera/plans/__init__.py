"""Queries of the library over the driver's tables."""

from . import change, evidence, governance, retrieval  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
