"""The core queries by name, and their SQL."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

MODULES: tuple[str, ...] = ("operators.retrieval_metrics", "operators.claim_metrics", "operators.aggregates", "operators.agreement", "operators.text_units", "operators.search", "operators.citation_scores", "operators.sampling", "operators.replies", "operators.pairs", "operators.quotes", "sources.files", "streaming.logs")

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in MODULES:
    _m = importlib.import_module(f"{__package__}.{_name}")
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The retrieval arms scored side by side."""
    return QUERIES["rt11_arm_metrics"](spark, d)
