"""All named queries of the reference's operators over the provided tables."""

from __future__ import annotations

from verspan.plans import engine_queries, graph_queries, history_queries, join_queries, search_queries, text_queries  # noqa: F401
from verspan.plans.diff_queries import *  # noqa: F403
from verspan.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
