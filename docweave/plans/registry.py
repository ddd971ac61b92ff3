"""The registered queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docweave.plans import business_queries, identity_queries, page_queries, provenance_queries, scoring_queries, utility_queries

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (scoring_queries, identity_queries, page_queries, provenance_queries, business_queries, utility_queries, provenance_queries)


def queries() -> dict[str, Query]:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return business_queries.business_records(spark, sf_dir)
