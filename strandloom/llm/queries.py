"""The registered queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, jaccard, language_id, license_scan, lm_score, merkle, packing, pii, prefix_trie, quality, rabitq, secret_scan, url_filter

MODULES = (bpe, jaccard, language_id, license_scan, lm_score, merkle, packing, pii, prefix_trie, quality, rabitq, secret_scan, url_filter)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(module, name) for module in MODULES for name in vars(module) if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in getattr(module, "ORACLE_SQL", {}).items()}
