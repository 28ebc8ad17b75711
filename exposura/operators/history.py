"""Features that see only strictly earlier events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from exposura.functions.checks import require_columns, require_unique
from exposura.functions.columns import (
    MS_PER_HOUR, day_of_week_of, finite_or_zero, hour_of, ratio, smoothed_rate,
)
from exposura.functions.scale import ROWS_PER_TASK, SLICE_MS, HOT_SHARE, earlier_totals
from exposura.session import materialize

# The feature set and the side-table columns the rankers are trained on.
FEATURE_COLUMNS = (
    "retrieval_score", "retrieval_rank", "hist_item_exposure", "hist_item_reward_rate",
    "hist_user_exposure", "hist_user_long_view_rate", "hour", "day_of_week", "tab",
    "session_position", "video_duration", "register_days", "follow_user_num", "fans_user_num",
    "friend_user_num",
)
USER_SIDE_COLUMNS = ("register_days", "follow_user_num", "fans_user_num", "friend_user_num")
ITEM_SIDE_COLUMNS = ("video_duration",)


def _events_at(events: DataFrame, *keys: str) -> DataFrame:
    """Exposures and positives per key and timestamp: heavy ties collapse before any window."""
    return events.groupBy(*keys, "timestamp_ms").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col("long_view").cast("long")).alias("_p")
    )


def prior_global_totals(timestamps: DataFrame, events: DataFrame) -> DataFrame:
    """``(timestamp_ms, prior_n, prior_p)``: events and positives strictly before each given timestamp.

    A window without a key would run in one task. Totals per timestamp are accumulated inside one
    UTC hour (at most 3.6 million distinct milliseconds), and the hour totals (one row per hour of
    the calendar) are accumulated apart.
    """
    zeros = timestamps.select("timestamp_ms").distinct().select(
        "timestamp_ms", F.lit(0).cast("long").alias("_n"), F.lit(0).cast("long").alias("_p")
    )
    per_ts = (
        _events_at(events).unionByName(zeros).groupBy("timestamp_ms").agg(F.sum("_n").alias("_n"), F.sum("_p").alias("_p"))
        .withColumn("_hour", F.floor(F.col("timestamp_ms") / MS_PER_HOUR))
    )
    inside = Window.partitionBy("_hour").orderBy("timestamp_ms").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = (
        per_ts.groupBy("_hour").agg(F.sum("_n").alias("_hn"), F.sum("_p").alias("_hp"))
        .select("_hour", F.sum("_hn").over(before).alias("_bn"), F.sum("_hp").over(before).alias("_bp"))
    )
    zero = F.lit(0)
    n = F.coalesce("_bn", zero) + F.coalesce(F.sum("_n").over(inside), zero)
    p = F.coalesce("_bp", zero) + F.coalesce(F.sum("_p").over(inside), zero)
    return per_ts.join(hours, "_hour").select("timestamp_ms", n.alias("prior_n"), p.alias("prior_p"))


def prior_global_rate(timestamps: DataFrame, events: DataFrame) -> DataFrame:
    """``(timestamp_ms, prior_rate)``: positive share of all strictly earlier events, 0 if there are none."""
    rate = F.coalesce(ratio(F.col("prior_p"), F.col("prior_n")), F.lit(0.0))
    return prior_global_totals(timestamps, events).select("timestamp_ms", rate.alias("prior_rate"))


def historical_features(
    log: DataFrame, alpha: float = 20.0, slice_width: int = SLICE_MS, min_rows: int = ROWS_PER_TASK,
    share: float = HOT_SHARE,
) -> DataFrame:
    """Per row: item and user exposures before its timestamp and the smoothed positive rates.

    Rows of the same timestamp never count for each other; the prior is the global rate of all
    strictly earlier rows, 0 where there are none. The prior is stored: where timestamps are few, Spark
    sees how small it is and does not shuffle the log to it. The log is read several times: pass a stored
    table, not an unfinished join.
    """
    require_columns(log, ["user_id", "item_id", "timestamp_ms", "long_view"], "history input")
    prior, work = materialize(prior_global_rate(log, log)), log
    for key, prefix in (("item_id", "item"), ("user_id", "user")):
        work = earlier_totals(
            work, [key], "timestamp_ms",
            {f"hist_{prefix}_exposure": F.lit(1), f"_{prefix}_positive": F.col("long_view").cast("long")},
            slice_width=slice_width, min_rows=min_rows, share=share, counted=log,
        )
    return _with_rates(work.join(prior, "timestamp_ms"), log.columns, alpha).withColumn(
        "feature_cutoff_ms", F.col("timestamp_ms") - 1
    )


def _with_rates(work: DataFrame, columns: list[str], alpha: float) -> DataFrame:
    def rate(prefix: str) -> Column:
        return smoothed_rate(F.col(f"_{prefix}_positive"), F.col(f"hist_{prefix}_exposure"), F.col("prior_rate"), alpha)

    return work.select(
        *columns, "hist_item_exposure", "hist_user_exposure",
        rate("item").alias("hist_item_reward_rate"), rate("user").alias("hist_user_long_view_rate"),
    )


def asof_totals(
    rows: DataFrame, events: DataFrame, keys: list[str], exposure: str, positive: str,
    slice_width: int = SLICE_MS, min_rows: int = ROWS_PER_TASK, share: float = HOT_SHARE,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Backward as-of join, strict: totals of ``events`` of the same key before each row's timestamp.

    Rows and events are united and one range frame ending just before the row's timestamp does the
    matching, so there is no inequality join. ``counted`` may stand in for ``rows`` where keys are
    counted to find hot ones.
    """
    left = rows.withColumns({"_n": F.lit(0).cast("long"), "_p": F.lit(0).cast("long"), "_is_row": F.lit(True)})
    right = _events_at(events, *keys).withColumn("_is_row", F.lit(False))
    united = left.unionByName(right, allowMissingColumns=True)
    keyed = (rows if counted is None else counted).select(*keys).unionByName(events.select(*keys))
    totals = earlier_totals(
        united, keys, "timestamp_ms", {exposure: F.col("_n"), positive: F.col("_p")},
        slice_width=slice_width, min_rows=min_rows, share=share, counted=keyed,
    )
    return totals.where(F.col("_is_row")).select(*rows.columns, exposure, positive)


def point_in_time_aggregates(
    rows: DataFrame, history: DataFrame, alpha: float = 20.0, slice_width: int = SLICE_MS,
    min_rows: int = ROWS_PER_TASK, share: float = HOT_SHARE,
) -> DataFrame:
    """Attach history statistics as of each row's timestamp (events at that timestamp excluded)."""
    events = history.select("timestamp_ms", "user_id", "item_id", "long_view")
    work = rows
    for key, prefix in (("item_id", "item"), ("user_id", "user")):
        work = asof_totals(
            work, events, [key], f"hist_{prefix}_exposure", f"_{prefix}_positive", slice_width, min_rows, share, rows
        )
    return _with_rates(work.join(prior_global_rate(rows, events), "timestamp_ms"), rows.columns, alpha)


def training_aggregates(train: DataFrame, alpha: float = 20.0) -> tuple[DataFrame, DataFrame]:
    """Item table and user table: exposures and smoothed positive rate over the whole training log."""
    overall = train.agg(F.avg("long_view").alias("rate"))

    def table(key: str, exposure: str, rate: str) -> DataFrame:
        grouped = train.groupBy(key).agg(F.count(F.lit(1)).alias(exposure), F.sum("long_view").alias("_p"))
        return grouped.select(
            key, exposure, smoothed_rate(F.col("_p"), F.col(exposure), overall.scalar(), alpha).alias(rate)
        )

    return (
        table("item_id", "hist_item_exposure", "hist_item_reward_rate"),
        table("user_id", "hist_user_exposure", "hist_user_long_view_rate"),
    )


def normalize_features(rows: DataFrame, features: tuple[str, ...] = FEATURE_COLUMNS) -> DataFrame:
    """Every feature as a finite double: absent columns and unusable values become 0."""
    return rows.withColumns(
        {name: finite_or_zero(F.col(name)) if name in rows.columns else F.lit(0.0) for name in features}
    )


def ranker_features(
    rows: DataFrame, history: DataFrame, users: DataFrame | None = None, items: DataFrame | None = None,
    point_in_time: bool = False, use_side_features: bool = False, alpha: float = 20.0,
) -> DataFrame:
    """History, clock and (only on request) undated side-table features for ranking rows."""
    if point_in_time:
        result = point_in_time_aggregates(rows, history, alpha)
    else:
        item_table, user_table = training_aggregates(history, alpha)
        result = rows.join(item_table, "item_id", "left").join(user_table, "user_id", "left")
    if use_side_features:
        for side, key, wanted in ((users, "user_id", USER_SIDE_COLUMNS), (items, "item_id", ITEM_SIDE_COLUMNS)):
            present = [name for name in wanted if side is not None and name in side.columns]
            if present:
                result = result.join(require_unique(side.select(key, *present), [key], "side table"), key, "left")
    clocked = result.withColumns(
        {"hour": hour_of(F.col("timestamp_ms")), "day_of_week": day_of_week_of(F.col("timestamp_ms"))}
    )
    return normalize_features(clocked)


def recent_activity(
    rows: DataFrame, window_ms: int = 86_400_000, slice_width: int = SLICE_MS, min_rows: int = ROWS_PER_TASK,
    share: float = HOT_SHARE,
) -> DataFrame:
    """Per row: the user's events and positives in the preceding window (the row's own instant excluded),
    whether the item is new to the user, and the time since the user last saw the item's category.

    The bounded counts are differences of two running totals and the last sight is a running maximum,
    so hot users are sliced like in every other history feature.
    """
    name = {"_all": F.lit(1), "_positive": F.col("long_view").cast("long")}
    work = earlier_totals(rows, ["user_id"], "timestamp_ms", name, slice_width=slice_width, min_rows=min_rows, share=share)
    # totals before (timestamp - window): one probe row per event, placed on the window's left edge
    probes = work.select("user_id", (F.col("timestamp_ms") - window_ms).alias("timestamp_ms")).distinct()
    edge = asof_totals(
        probes, rows, ["user_id"], "_all_edge", "_positive_edge", slice_width, min_rows, share
    ).withColumn("timestamp_ms", F.col("timestamp_ms") + window_ms)
    counted = work.join(edge, ["user_id", "timestamp_ms"]).withColumns(
        {
            "recent_events": F.col("_all") - F.col("_all_edge"),
            "recent_positives": F.col("_positive") - F.col("_positive_edge"),
        }
    )
    kind = F.coalesce(F.col("category").cast("string"), F.lit("unknown"))
    seen = counted.withColumn("_kind", kind)
    for key, name in (("item_id", "_last_item"), ("_kind", "_last_kind")):
        seen = earlier_totals(
            seen, ["user_id", key], "timestamp_ms", {name: F.col("timestamp_ms")}, slice_width=slice_width,
            min_rows=min_rows, share=share, counted=rows.withColumn("_kind", kind), combine="max",
        )
    return seen.select(
        *rows.columns, "recent_events", "recent_positives", F.col("_last_item").isNull().cast("int").alias("is_novel"),
        (F.col("timestamp_ms") - F.col("_last_kind")).alias("ms_since_category"),
    )
