"""Operators for training-data pipelines, and their queries."""

from ripplework.llm import queries as _queries  # noqa: F401
from ripplework.llm.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
