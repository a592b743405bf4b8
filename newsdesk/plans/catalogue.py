"""All feed-engine queries and their oracles, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import documents, edges, relational, reports, scalars, stages, streams

FLAGSHIP = "m0_tier_histogram"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (*scalars.QUERIES, *relational.QUERIES, *reports.QUERIES, *documents.QUERIES, *stages.QUERIES, *edges.QUERIES, *streams.QUERIES)}


def oracle_sql() -> dict[str, str]:
    return scalars.ORACLES | relational.ORACLES | reports.ORACLES | documents.ORACLES | stages.ORACLES | edges.ORACLES | streams.ORACLES
