"""All queries of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesserae.plans import images, serving, tabular


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return tabular.QUERIES | images.QUERIES | serving.QUERIES


def oracle_sql() -> dict[str, str]:
    return tabular.SQL | images.SQL | serving.SQL
