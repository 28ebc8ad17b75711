"""Embedding tables ``(id, embedding)`` as parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from exposura.operators.popularity import require_valid_embeddings


def write_embeddings(table: DataFrame, path: str, key: str) -> None:
    """Check the table (non-empty, unique ids, one dimension, finite) and write it."""
    require_valid_embeddings(table, key).select(key, F.col("embedding").cast("array<float>")).write.mode("overwrite").parquet(path)


def read_embeddings(spark: SparkSession, path: str, key: str) -> DataFrame:
    return require_valid_embeddings(spark.read.parquet(path).select(key, "embedding"), key)
