"""Readers for the driver's parquet tables.

Readers return lazy DataFrames; column pruning and predicate pushdown reach
the parquet scan because every operator only selects what it needs.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Register the driver tables and corridor's derived views for SQL users."""
    from . import fixtures
    for t in TABLES:
        if os.path.exists(table_path(sf_dir, t)):
            read_table(spark, sf_dir, t).createOrReplaceTempView(t)
    for name, fn in fixtures.BUILDERS.items():
        fn(spark, sf_dir).createOrReplaceTempView(name)
