"""All queries of the core, by name."""

from __future__ import annotations

from . import audit_queries, grid_queries, prompt_queries, record_queries, score_queries, text_queries, vital_queries
from .query import Query


def registry() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in (grid_queries, vital_queries, text_queries, prompt_queries, record_queries, score_queries, audit_queries):
        for name, q in module.QUERIES.items():
            if name in found:
                raise ValueError(f"query {name} is defined twice")
            found[name] = q
    return found
