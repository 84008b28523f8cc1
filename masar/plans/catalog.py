"""Every query of the library by name, and its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from masar.plans import assistant, codecs, decisions, feedqueries, geometry, language, linkqueries, placequeries, rest, stopqueries, talk, traffic, tripqueries  # noqa: F401  registers their queries
from masar.plans.registry import ORACLES, QUERIES, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Congestion of each reading's junction at its hour and weekday, with its level."""
    return traffic.hist_lookup(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
