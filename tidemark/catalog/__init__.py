"""Registered queries and the SQL each is checked against."""

from __future__ import annotations

from tidemark.catalog.base import REGISTRY
from tidemark.catalog import modules as _modules  # noqa: F401  (importing registers the queries)

__all__ = ["REGISTRY"]
