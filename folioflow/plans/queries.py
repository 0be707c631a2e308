"""Registered queries of the document and retrieval engine, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioflow.plans import catalog_queries, chat_queries, state_queries, study_queries, text_queries

PARTS = [text_queries.R, catalog_queries.R, chat_queries.R, study_queries.R, state_queries.R]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_queries.flagship(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for r in PARTS for k, f in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for r in PARTS for k, s in r.sql.items()}
