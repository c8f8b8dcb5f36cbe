"""All registered queries."""

from __future__ import annotations

from tallyfold.plans import (  # noqa: F401
    evaluation_queries,
    grouped_questions,
    operator_queries,
    quality_queries,
    similarity_queries,
    simple_questions,
)
from tallyfold.plans.registry import REGISTRY


def names() -> list[str]:
    return list(REGISTRY)


def sql_texts() -> dict[str, str]:
    return {name: entry.sql for name, entry in REGISTRY.items() if entry.sql is not None}
