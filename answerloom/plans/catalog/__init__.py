"""Registered queries, each next to the SQL that must give the same rows."""

from answerloom.plans.catalog.registry import ORACLES, QUERIES
from answerloom.plans.catalog import (  # noqa: F401  (fill the registry)
    batch_queries, evaluation_queries, pair_queries, retrieval_queries, source_queries,
    stream_queries, text_queries, tokenizer_queries,
)

__all__ = ["ORACLES", "QUERIES"]
