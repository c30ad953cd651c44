"""Loads every query of this subpackage."""

from __future__ import annotations

from stratiform.llm import model_queries, native_queries, registry, search_queries, text_queries

__all__ = ["model_queries", "native_queries", "registry", "search_queries", "text_queries"]
