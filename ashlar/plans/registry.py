"""Named queries over the driver's tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import binning, fitting


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit, decompose, and compare tree scores with table scores row by row."""
    return fitting.fit_and_explain(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**binning.QUERIES, **fitting.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**binning.ORACLE, **fitting.ORACLE}
