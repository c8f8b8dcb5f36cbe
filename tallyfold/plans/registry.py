"""Registry of queries: a name, the Spark plan, and independent SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tallyfold.sources.mapped import BASE_TABLES, VIEWS, MappedTables

ORDER_COPIES_SQL = (
    "CROSS JOIN (VALUES (0), (1)) copies(copy) WHERE copy = 0 OR o_orderkey % 500 = 0"
)


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[MappedTables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a plan under a name. ``sql`` may use ``r_<table>`` for the business tables."""

    def keep(build: Callable[[MappedTables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, build, sql)
        return build

    return keep


def run(name: str, spark: SparkSession, path: str) -> DataFrame:
    return REGISTRY[name].build(MappedTables(spark, path))


def complete_sql(sql: str) -> str:
    """Prefix the definitions of the ``r_*`` views a text uses."""
    wanted = [name for name in VIEWS if re.search(rf"\br_{name}\b", sql)]
    views = []
    for name in wanted:
        text = VIEWS[name].replace("{order_copies}", ORDER_COPIES_SQL)
        for base in BASE_TABLES:
            text = text.replace(f"{{{base}}}", base)
        views.append(f"r_{name} AS ({text})")
    body = sql.strip()
    if not views:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {', '.join(views)}, {body[5:]}"
    return f"WITH {', '.join(views)} {body}"
