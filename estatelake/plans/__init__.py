"""Queries by family; each module gives its queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import filters_q, joins_q, more_q, portals_q, quality_q, stats_q, stream_q

FAMILIES = (filters_q.family, joins_q.family, more_q.family, portals_q.family, quality_q.family, stats_q.family, stream_q.family)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for f in FAMILIES for name, q in f.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for f in FAMILIES for name, q in f.sql.items()}
