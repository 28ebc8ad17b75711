"""NDCG, recall and MRR of ranked impressions, per evaluation group and averaged.

Many models and domains are evaluated in one job by listing their columns in ``by``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from exposura.functions.columns import discount, ideal_gain, ratio

METRICS = ("ndcg", "recall", "mrr")


def evaluation_group(frame: DataFrame, group_by: str = "auto") -> Column:
    """``context`` groups by context_id, ``user_date`` by user and day, ``auto`` by what is there."""
    if group_by == "context" or (group_by == "auto" and "context_id" in frame.columns):
        return F.col("context_id").cast("string")
    return F.concat_ws(":", F.col("user_id").cast("string"), F.col("date").cast("string"))


def rank_order(frame: DataFrame) -> list[Column]:
    """Score descending, item ascending, then time: a total order for logged impressions."""
    extra = [F.col("timestamp_ms")] if "timestamp_ms" in frame.columns else []
    return [F.desc("score"), F.col("item_id"), *extra]


def top_per_group(frame: DataFrame, k: int, group: Sequence[str] = ("context_id",), rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group by score. Each task keeps only ``k`` rows per group before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*rank_order(frame))
    return frame.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def ranking_metrics_per_group(
    frame: DataFrame, k_values: Sequence[int] = (5, 10, 20), min_group_size: int = 2,
    by: Sequence[str] = (), group_by: str = "auto",
) -> DataFrame:
    """One row per (by, evaluation_group, k) for groups with enough rows and at least one positive.

    Group totals are partial aggregates; only the top ``max(k)`` rows per group are shuffled and
    ranked, so a group of any size costs one task no more than ``max(k)`` rows per map task.
    """
    by = list(by)
    group = [*by, "evaluation_group"]
    work = frame.withColumn("evaluation_group", evaluation_group(frame, group_by))
    totals = (
        work.groupBy(*group)
        .agg(F.count(F.lit(1)).alias("group_rows"), F.sum(F.col("long_view").cast("long")).alias("_positives"))
        .where((F.col("group_rows") >= min_group_size) & (F.col("_positives") > 0))
    )
    top = top_per_group(work, max(k_values), group, "_rank")
    rank, positive = F.col("_rank"), F.col("long_view") == 1
    hits = top.groupBy(*group).agg(
        F.min_by("user_id", "_rank").alias("user_id"),
        F.min_by("date", "_rank").alias("date"),
        F.min(F.when(positive, rank)).alias("_first"),
        *[F.sum(F.when(rank <= k, F.col("long_view").cast("long"))).alias(f"_hits_{k}") for k in k_values],
        *[F.sum(F.when(rank <= k, F.col("long_view") * discount(rank))).alias(f"_dcg_{k}") for k in k_values],
    )
    at_k = [
        F.struct(
            F.lit(k).alias("k"),
            (F.col(f"_dcg_{k}") / ideal_gain(F.col("_positives"), F.lit(k))).alias("ndcg"),
            (F.col(f"_hits_{k}") / F.col("_positives")).alias("recall"),
            F.when(F.col("_first") <= k, F.lit(1.0) / F.col("_first")).otherwise(F.lit(0.0)).alias("mrr"),
        )
        for k in k_values
    ]
    return hits.join(totals, group).select(
        *group, "user_id", "date", "group_rows", F.explode(F.array(*at_k)).alias("_m")
    ).select(*group, "user_id", "date", "group_rows", "_m.*")


def average_metrics(per_group: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unweighted means over groups, with the number of eligible groups and rows, per (by, k)."""
    return per_group.groupBy(*by, "k").agg(
        *[F.avg(m).alias(m) for m in METRICS],
        F.count(F.lit(1)).alias("eligible_groups"),
        F.sum("group_rows").alias("eligible_rows"),
    )


def ranking_metrics(
    frame: DataFrame, k_values: Sequence[int] = (5, 10, 20), min_group_size: int = 2,
    by: Sequence[str] = (), group_by: str = "auto",
) -> DataFrame:
    return average_metrics(ranking_metrics_per_group(frame, k_values, min_group_size, by, group_by), by)


def metrics_by_user(per_group: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return per_group.groupBy(*by, "user_id", "k").agg(
        *[F.avg(m).alias(m) for m in METRICS], F.count(F.lit(1)).alias("contexts")
    )


def long_metrics(metrics: DataFrame, by: Sequence[str] = ("model", "domain")) -> DataFrame:
    """``(by, metric, value)`` with metric names like ``ndcg@10``."""
    return metrics.select(
        *by, "k", F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).alias("value")) for m in METRICS])).alias("_e")
    ).select(*by, F.concat_ws("@", F.col("_e.m"), F.col("k").cast("string")).alias("metric"), F.col("_e.value").alias("value"))


def exposure_gap(long: DataFrame) -> DataFrame:
    """Standard minus randomized per (model, metric), for metrics known in both domains."""
    wide = long.groupBy("model", "metric").pivot("domain", ["standard", "randomized"]).agg(F.first("value"))
    return wide.where(F.col("standard").isNotNull() & F.col("randomized").isNotNull()).withColumns(
        {
            "gap": F.col("standard") - F.col("randomized"),
            "normalized_gap": ratio(F.col("standard") - F.col("randomized"), F.col("standard")),
        }
    )


def ranking_stability(long: DataFrame, metric: str = "ndcg@10") -> DataFrame:
    """Spearman correlation of the model order in the two domains, with both orders.

    One row per model reaches this step, so its windows are tiny whatever the log size. The
    correlation is null for fewer than two models.
    """
    pairs = (
        long.where(F.col("metric") == metric).groupBy("model")
        .pivot("domain", ["standard", "randomized"]).agg(F.first("value"))
        .where(F.col("standard").isNotNull() & F.col("randomized").isNotNull())
    )

    def average_rank(column: str) -> Column:
        ordered, peers = Window.orderBy(column), Window.partitionBy(column)
        return F.rank().over(ordered) + (F.count(F.lit(1)).over(peers) - 1) / F.lit(2.0)

    def order_of(column: str) -> Column:
        entries = F.array_sort(F.collect_list(F.struct((-F.col(column)).alias("s"), F.col("model"))))
        return F.array_join(F.transform(entries, lambda e: e["model"]), ",")

    ranked = pairs.withColumns({"_s": average_rank("standard"), "_r": average_rank("randomized")})
    return ranked.agg(
        F.lit(metric).alias("metric"),
        F.when(F.count(F.lit(1)) > 1, F.corr("_s", "_r")).alias("spearman"),
        F.count(F.lit(1)).alias("model_count"),
        order_of("standard").alias("standard_order"),
        order_of("randomized").alias("randomized_order"),
    )


def mean_average_precision(
    frame: DataFrame, k_values: Sequence[int] = (5, 10, 20), min_group_size: int = 2, by: Sequence[str] = (),
    group_by: str = "auto",
) -> DataFrame:
    """MAP@k over eligible groups: precision at every hit, summed, over min(k, positives)."""
    by = list(by)
    group = [*by, "evaluation_group"]
    work = frame.withColumn("evaluation_group", evaluation_group(frame, group_by))
    totals = (
        work.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"), F.sum("long_view").alias("_positives"))
        .where((F.col("_rows") >= min_group_size) & (F.col("_positives") > 0))
    )
    top = top_per_group(work, max(k_values), group, "_rank")
    so_far = Window.partitionBy(*group).orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)
    gained = top.withColumn("_gain", F.col("long_view") * F.sum("long_view").over(so_far) / F.col("_rank"))
    sums = gained.groupBy(*group).agg(
        *[F.sum(F.when(F.col("_rank") <= k, F.col("_gain"))).alias(f"_gain_{k}") for k in k_values]
    ).join(totals, group)
    at_k = [
        F.struct(F.lit(k).alias("k"), (F.col(f"_gain_{k}") / F.least(F.lit(k), F.col("_positives"))).alias("_ap"))
        for k in k_values
    ]
    return sums.select(*by, F.explode(F.array(*at_k)).alias("_m")).select(*by, "_m.*").groupBy(*by, "k").agg(
        F.avg("_ap").alias("map"), F.count(F.lit(1)).alias("groups")
    )
