"""Readers for the driver-generated parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazily scan one parquet table; projection and filters push into the scan."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dimension(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the data, joined by a merge of shuffled rows.

    A scan's size is guessed from its compressed files, which lets a table of a million rows pass for a
    small one; it would go through the driver to every task of the join."""
    return df.hint("merge")
