"""The named read registry: every query by name, for Spark and as SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from storyspark.operators import facts, graphs, text_metrics, vectors, views
from storyspark.operators import custom
from storyspark.plans.dialect import Dialect

_SQL = text_metrics.QUERIES | facts.QUERIES | graphs.QUERIES | vectors.QUERIES | views.QUERIES


def _run(build: Callable[[Dialect], str]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = Dialect("spark", sf_dir)
        return spark.sql(d.finish(build(d)))

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _run(q) for name, q in _SQL.items()} | custom.QUERIES


def oracle_sql() -> dict[str, str]:
    d = Dialect("duckdb")
    return {name: d.finish(q(d)) for name, q in _SQL.items()} | {name: d.finish(q(d)) for name, q in custom.ORACLES.items()}
