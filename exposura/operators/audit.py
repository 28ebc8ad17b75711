"""Log audits: coverage, duplicates, missing values, rates, overlap, long tails, leakage rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from exposura.functions.columns import ratio
from exposura.functions.scale import ROWS_PER_TASK, ordered_position


def coverage_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("source_log", "is_random").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("user_id").alias("users"),
        F.count_distinct("item_id").alias("items"),
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
    )


def log_audit(log: DataFrame, approximate: bool = False) -> DataFrame:
    """Rows, users, items, date and time range per log; ``approximate`` swaps in HLL distinct counts."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return log.groupBy("source_log").agg(
        F.max("is_random").alias("is_random"),
        F.count(F.lit(1)).alias("rows"),
        F.min("date").alias("min_date"), F.max("date").alias("max_date"),
        F.min("timestamp_ms").alias("min_timestamp_ms"), F.max("timestamp_ms").alias("max_timestamp_ms"),
        distinct("user_id").alias("users"), distinct("item_id").alias("items"),
    )


def duplicate_keys(log: DataFrame) -> DataFrame:
    """One row: rows whose (log, user, item, time) key occurs more than once, all copies counted."""
    copies = log.groupBy("source_log", "user_id", "item_id", "timestamp_ms").agg(F.count(F.lit(1)).alias("n"))
    return copies.agg(
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows"),
        F.count_if(F.col("n") > 1).alias("duplicate_keys"),
    )


def missing_values(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table and column: type, rows and null count. One pass per table."""
    result = None
    for name, table in tables.items():
        entries = [
            F.struct(
                F.lit(name).alias("table_name"), F.lit(column).alias("column_name"), F.lit(dtype).alias("data_type"),
                F.count(F.lit(1)).alias("rows"), F.count_if(F.col(f"`{column}`").isNull()).alias("missing"),
            )
            for column, dtype in table.dtypes
        ]
        part = table.agg(F.array(*entries).alias("_e")).select(F.explode("_e").alias("_e")).select("_e.*")
        result = part if result is None else result.unionByName(part)
    return result


def reward_rates(log: DataFrame, keys: Sequence[str] = ("source_log", "is_random")) -> DataFrame:
    return log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("long_view").alias("long_view_rate"),
        F.avg("is_click").alias("click_rate"),
        F.avg("is_like").alias("like_rate"),
    )


def policy_overlap(log: DataFrame) -> DataFrame:
    """Users and items seen under each policy and under both: one grouping per entity."""
    def entity(name: str, key: str) -> DataFrame:
        seen = log.groupBy(key).agg(
            F.max(F.col("is_random") == 0).alias("_standard"), F.max(F.col("is_random") == 1).alias("_random")
        )
        return seen.agg(
            F.lit(name).alias("entity"),
            F.count_if("_standard").alias("standard_unique"),
            F.count_if("_random").alias("randomized_unique"),
            F.count_if(F.col("_standard") & F.col("_random")).alias("intersection"),
        )

    return entity("users", "user_id").unionByName(entity("items", "item_id"))


def activity_by_policy(log: DataFrame, key: str) -> DataFrame:
    """Rows per entity under each policy, 0 where a policy never met it."""
    return log.groupBy(key).agg(
        F.count_if(F.col("is_random") == 0).alias("standard"), F.count_if(F.col("is_random") == 1).alias("randomized")
    )


def tab_distribution(log: DataFrame, logs: Sequence[str] = ("standard_early", "standard_late", "random")) -> DataFrame:
    """Rows per tab and log, pivoted with a fixed list of logs (no extra pass to find them)."""
    counts = log.groupBy("tab").pivot("source_log", list(logs)).agg(F.count(F.lit(1)))
    return counts.na.fill(0, list(logs))


def daily_rates(log: DataFrame, logs: Sequence[str] = ("standard_early", "standard_late", "random")) -> DataFrame:
    return log.groupBy("date").pivot("source_log", list(logs)).agg(F.avg("long_view"))


def reward_shift(log: DataFrame) -> DataFrame:
    """Positive rate per tab under each policy and the difference."""
    rates = log.groupBy("tab").agg(
        F.coalesce(F.avg(F.when(F.col("is_random") == 0, F.col("long_view"))), F.lit(0.0)).alias("standard"),
        F.coalesce(F.avg(F.when(F.col("is_random") == 1, F.col("long_view"))), F.lit(0.0)).alias("randomized"),
    )
    return rates.withColumn("shift", F.col("standard") - F.col("randomized"))


def exposure_curve(log: DataFrame, min_rows: int = ROWS_PER_TASK) -> DataFrame:
    """Long-tail curve: exposures per item and policy with their descending rank."""
    counts = log.groupBy("is_random", "item_id").agg(F.count(F.lit(1)).alias("exposures"))
    return ordered_position(counts, -F.col("exposures"), "item_id", "rank", ["is_random"], min_rows)


def item_exposure_profile(log: DataFrame, min_rows: int = ROWS_PER_TASK) -> DataFrame:
    """Per item: share of each policy's rows, exposure percentile and popularity decile."""
    counts = activity_by_policy(log, "item_id").withColumn("exposures", F.col("standard") + F.col("randomized"))
    n = counts.agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.struct(F.sum("standard").alias("s"), F.sum("randomized").alias("r")).alias("t")).scalar()
    ranked = ordered_position(counts, F.col("exposures"), "item_id", "_rank", min_rows=min_rows)
    return ranked.select(
        "item_id", "exposures",
        ratio(F.col("standard"), totals["s"]).alias("standard_frequency"),
        ratio(F.col("randomized"), totals["r"]).alias("randomized_frequency"),
        (F.col("_rank") / n.scalar()).alias("exposure_percentile"),
        F.ceil(F.col("_rank") * 10 / n.scalar()).cast("int").alias("popularity_decile"),
    )


# The rule each column falls under before it may feed a model.
OUTCOME_COLUMNS = (
    "is_click", "is_like", "is_follow", "is_comment", "is_forward", "is_hate", "long_view", "play_time_ms",
    "duration_ms", "profile_stay_time", "comment_stay_time", "is_profile_enter",
)
IDENTIFIER_COLUMNS = ("user_id", "item_id", "video_id")
EXPOSURE_COLUMNS = ("timestamp_ms", "date", "tab")


def leakage_audit(tables: Mapping[str, DataFrame], log_table: str = "interactions") -> DataFrame:
    """``(table, column, status, reason)`` for every column of the given tables.

    Rules are expressions over rows of (table, column), with the null count of the column from one pass
    over its table as supporting evidence.
    """
    column, is_log = F.col("column_name"), F.col("table_name") == log_table
    status = (
        F.when(column.isin(*IDENTIFIER_COLUMNS), "identifier only")
        .when(is_log & column.isin(*EXPOSURE_COLUMNS), "allowed exposure-time context")
        .when(is_log & (column == "hourmin"), "excluded redundant context")
        .when(is_log, "excluded")
        .when(column == "tag", "analysis only")
        .otherwise("excluded from primary models")
    )
    reason = (
        F.when(column.isin(*IDENTIFIER_COLUMNS), "join key, never a numeric feature")
        .when(is_log & column.isin(*OUTCOME_COLUMNS), "outcome or behaviour after the exposure")
        .when(is_log & (column == "is_random"), "logging policy; randomized rows never train a model")
        .when(is_log & column.isin(*EXPOSURE_COLUMNS), "known at exposure time")
        .when(is_log & (column == "hourmin"), "hour and weekday come from the timestamp")
        .when(is_log, "bookkeeping of the source")
        .when(column == "tag", "used for calibration analysis after the fact")
        .otherwise("no date from which the value was known")
    )
    return missing_values(tables).select(
        "table_name", "column_name", status.alias("status"), reason.alias("reason"), "rows", "missing"
    )
