"""Registered queries; importing the package fills the registry."""

from detectlab.plans import corpus_queries, report_queries, stream_queries, text_queries, value_queries, variant_queries  # noqa: F401
from detectlab.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
