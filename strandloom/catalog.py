"""Registered queries of the retrieval operators and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandloom.plans import document_queries, evaluation_queries, failure_queries, quality_queries, request_queries, retrieval_queries, text_queries

MODULES = (retrieval_queries, text_queries, quality_queries, document_queries, evaluation_queries, request_queries, failure_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in MODULES for name, f in module.REGISTRY.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.REGISTRY.oracles.items()}
