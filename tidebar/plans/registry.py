"""All registered queries of the library, and the DuckDB statement of each that has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import adaptive_queries, audit_queries, channel_queries, confidence_queries, evaluation, forecast_queries, indicators, path_queries, prediction_queries, preparation_queries, report_queries, selection_queries, sequence_queries, target_queries

_PARTS = (indicators, sequence_queries, evaluation, prediction_queries, confidence_queries, target_queries, channel_queries, preparation_queries, report_queries, adaptive_queries, audit_queries, path_queries, forecast_queries, selection_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for part in _PARTS for name, q in part.QUERIES.items()}


def oracle() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
