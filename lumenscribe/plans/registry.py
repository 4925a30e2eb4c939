"""Queries and their oracle SQL by name."""

from __future__ import annotations

from lumenscribe.plans import layout_queries, text_queries

QUERIES: dict = {**text_queries.QUERIES, **layout_queries.QUERIES}
SQL: dict[str, str] = {**text_queries.SQL, **layout_queries.SQL}
