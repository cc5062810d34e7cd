"""All queries of the library by name, with the SQL that equals them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.plans import analysis, catalogue, graph_queries, ranking_queries, references, report_queries

_MODULES = [references, catalogue, analysis, ranking_queries, report_queries, graph_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.p5_by_month(spark, sf_dir)
