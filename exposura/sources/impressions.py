"""Impression logs and side tables from CSV, and the split sinks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from exposura.functions.checks import enforce, require_columns

# Required columns of a raw log and the names they get.
REQUIRED_COLUMNS = (
    "user_id", "video_id", "date", "time_ms", "is_click", "is_like", "is_follow", "is_comment", "is_forward",
    "is_hate", "long_view", "play_time_ms", "duration_ms", "is_rand", "tab",
)
RENAMED = {"video_id": "item_id", "time_ms": "timestamp_ms", "is_rand": "is_random"}
LONG_COLUMNS = ("user_id", "item_id", "timestamp_ms", "play_time_ms", "duration_ms")
INT_COLUMNS = (
    "date", "tab", "long_view", "is_click", "is_like", "is_follow", "is_comment", "is_forward", "is_hate", "is_random",
    "is_profile_enter",
)
# Log name and the policy flag its rows must carry.
LOG_POLICY = {"standard_early": 0, "standard_late": 0, "random": 1}
# What no row of a log may lack.
FILLED_COLUMNS = ("user_id", "item_id", "timestamp_ms", "date", "tab", "long_view")
MANIFEST_COLUMNS = ("user_id", "item_id", "timestamp_ms", "date", "is_random", "source_log", "split")


def canonical_log(raw: DataFrame, source_log: str, expected_random: int) -> DataFrame:
    """Rename and cast a raw log; bad numbers, empty keys or labels, non-binary and wrong-policy flags raise when read."""
    require_columns(raw, REQUIRED_COLUMNS, source_log)
    renamed = raw.withColumnsRenamed(RENAMED)
    casts = {c: F.col(c).cast("bigint") for c in LONG_COLUMNS} | {
        c: F.col(c).cast("int") for c in INT_COLUMNS if c in renamed.columns
    }
    typed = renamed.withColumns(casts).withColumn("source_log", F.lit(source_log))
    filled = enforce(
        typed, F.forall(F.array(*[F.col(c).isNotNull() for c in FILLED_COLUMNS]), lambda x: x),
        f"{source_log} holds rows without one of {FILLED_COLUMNS}",
    )
    return enforce(filled, policy_is_valid(F.lit(expected_random)), f"{source_log} holds rows of another or no policy")


def _read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV table with headers. A file whose header differs from the table's columns raises instead of being misread."""
    reader = spark.read.option("header", True).option("enforceSchema", False)
    return (reader if schema is None else reader.schema(schema)).csv(path)


def policy_is_valid(expected: Column) -> Column:
    return F.col("is_random").isin(0, 1) & (F.col("is_random") == expected)


def load_impressions(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Union of the standard and random CSV logs. ``paths`` maps log name to file, folder or glob.

    CSV columns are read as text and cast with ANSI rules. All files of one log must have the same header; another
    order of columns raises. The scan stays partitioned
    and nothing is sorted: order is a matter of the windows that need one.
    """
    if missing := sorted(set(LOG_POLICY) - set(paths)):
        raise ValueError(f"no path for logs {missing}")
    logs = [
        canonical_log(_read_csv(spark, paths[name]), name, flag)
        for name, flag in LOG_POLICY.items()
    ]
    result = logs[0]
    for log in logs[1:]:
        result = result.unionByName(log, allowMissingColumns=True)
    return result


def load_side_tables(
    spark: SparkSession, paths: Mapping[str, str], schemas: Mapping[str, T.StructType] | None = None
) -> dict[str, DataFrame]:
    """User and item tables; without an explicit schema the columns are text and are coerced where used."""
    schemas = schemas or {}
    tables = {}
    for name, path in paths.items():
        table = _read_csv(spark, path, schemas.get(name))
        tables[name] = table.withColumnRenamed("video_id", "item_id") if "video_id" in table.columns else table
    return tables


def file_summary(table: DataFrame) -> DataFrame:
    """Rows, bytes and column count per input file of a file-based DataFrame."""
    columns = len(table.columns)
    return table.groupBy(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes")
    ).agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(columns))


def write_splits(log: DataFrame, path: str) -> None:
    """Full rows partitioned by split, replacing what was there."""
    log.write.mode("overwrite").partitionBy("split").parquet(path)


def split_manifest(log: DataFrame) -> DataFrame:
    return log.select(*MANIFEST_COLUMNS)


def write_features(features: DataFrame, path: str) -> None:
    """Feature store by split and day, so later readers prune both."""
    features.write.mode("overwrite").partitionBy("split", "date").parquet(path)
