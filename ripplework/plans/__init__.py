"""Queries over the given tables."""

from ripplework.plans import (  # noqa: F401
    fit_queries,
    ingest_queries,
    shape_queries,
    stream_queries,
    tail_queries,
    verdict_queries,
)
from ripplework.plans.catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
