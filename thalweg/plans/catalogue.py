"""Named queries of the operators on the test tables, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from thalweg.plans import geometry, networks, outlines, refinement, signals

Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.transect_summary(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: q for m in (geometry, networks, signals, refinement, outlines) for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in (geometry, networks, signals, refinement, outlines) for name, (_, sql) in m.QUERIES.items() if sql}
