"""All queries on the indoor model."""

from floorloom.plans import network, runs, tables  # noqa: F401  registered by import
from floorloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
