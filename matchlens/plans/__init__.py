"""Named queries over the driver's tables."""

from . import corpus_queries, detail_queries, event_queries, search_queries, source_queries, stream_queries, timeline_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
