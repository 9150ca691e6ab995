"""Registered queries over the driver tables, with their equivalent SQL."""

from convoframe.plans import chat_queries, log_queries, search_queries, settings_queries  # noqa: F401
from convoframe.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
