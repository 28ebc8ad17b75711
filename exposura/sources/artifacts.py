"""Metric files, file manifests and unions of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from exposura.sources.files import file_report

DOMAINS = ("standard", "randomized")


def write_metrics(metrics: DataFrame, path: str, file_format: str = "json") -> None:
    """Write a metric table as JSON lines or as CSV with a header, replacing what was there."""
    writer = metrics.write.mode("overwrite")
    if file_format == "json":
        writer.json(path)
    elif file_format == "csv":
        writer.option("header", True).csv(path)
    else:
        raise ValueError("metric files are json or csv")


def artifact_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Path, bytes and sha256 of every file under ``path``; each is hashed in pieces by the task that reads it."""
    return file_report(spark, path).select("path", "bytes", "sha256")


def union_results(spark: SparkSession, path: str) -> DataFrame:
    """All result tables under ``path`` with ``model`` and ``domain`` read from ``model_domain`` folder names."""
    rows = spark.read.option("recursiveFileLookup", True).parquet(path).withColumn("_path", F.col("_metadata.file_path"))
    stem = F.regexp_extract("_path", r"([^/]+)/[^/]+$", 1)
    domain = F.coalesce(*[F.when(F.endswith(stem, F.lit(f"_{d}")), F.lit(d)) for d in DOMAINS], F.lit("unknown"))
    model = F.regexp_replace(stem, "_(standard|randomized)$", "")
    return rows.withColumns({"model": model, "domain": domain}).drop("_path")
