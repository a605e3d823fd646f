"""All registered core queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import catalog_queries, more_queries, search_queries, state_queries

QUERIES: dict = {**search_queries.QUERIES, **state_queries.QUERIES, **more_queries.QUERIES, **catalog_queries.QUERIES}
SQL: dict = {**search_queries.SQL, **state_queries.SQL, **more_queries.SQL, **catalog_queries.SQL}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Fielded BM25 over all active documents."""
    return search_queries.bm25_top(spark, d)
