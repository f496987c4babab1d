"""Queries of the library over the driver's tables."""

from corpusmill.plans import cleaning, integration, rewriting
from corpusmill.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "cleaning", "integration", "rewriting"]
